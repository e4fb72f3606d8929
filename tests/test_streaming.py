"""A batch operator applied to a file stream (variant filter on VCF lines)."""

import os
import tempfile

from omics_spark.operators.variants import filter_variants
from omics_spark.sources.formats import parse_vcf_lines
from omics_spark.streaming.files import apply_batches, stream_lines


def test_filter_variants_on_a_file_stream(spark):
    src = tempfile.mkdtemp(prefix="vcfin-")
    out = tempfile.mkdtemp(prefix="vcfout-") + "/sink"
    with open(os.path.join(src, "a.vcf"), "w") as fh:
        fh.write("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n")
        fh.write("c1\t10\t.\tA\tG\t30\tPASS\tDP=4\nc1\t20\t.\tC\tT\t5\tPASS\tDP=9\nc2\t5\t.\tG\tA\t.\tPASS\t.\n")
    q = apply_batches(stream_lines(spark, src), lambda b: filter_variants(parse_vcf_lines(b), "QUAL>20"),
                      out, available_now=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert [(r.contig, r.pos) for r in rows] == [("c1", 10)]
