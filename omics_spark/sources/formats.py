"""Text formats in and out (A1-A12): lines, FASTA, FASTQ, SAM, VCF, BED,
GFF3, PDB/PDBQT atoms. Readers return typed DataFrames (coordinates:
intervals 0-based half-open, reads/variants keep the 1-based ``pos``).
Writers emit a header then a globally ordered body (``orderBy`` range
partitions, so part files follow each other in order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import BLK, before, block_carry, in_block
from ..session import cut_lineage

# ---------------------------------------------------------------- lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A1: one row per line, column ``value``."""
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str, col: str = "value") -> None:
    """Overwrite a text sink from one string column."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """A2: files and folders in ``path`` (name, path, size, is_dir), sorted
    by name; folders have no size. A missing folder gives an empty table,
    other errors are raised. Any file system that Spark reads; nothing is
    opened."""
    schema = "name string, path string, size bigint, is_dir boolean"
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return spark.createDataFrame([], schema)
    found = [(f.getPath().getName(), f.getPath().toString(), None if f.isDirectory() else f.getLen(), f.isDirectory()) for f in fs.listStatus(folder)]
    return spark.createDataFrame(found, schema).orderBy("name")


def preview_lines(df: DataFrame, max_lines: int = 50) -> DataFrame:
    """A3: the first ``max_lines`` lines of :func:`read_lines`, files by
    path and lines as they stand in them, with ``line_no`` and a
    ``truncated`` flag (true when more lines exist). Each task keeps its own
    first ``max_lines + 1`` rows; the window runs over that bounded set only."""
    place = df.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                      F.monotonically_increasing_id().alias("_i"))
    head = place.orderBy("_f", "_b", "_i").limit(max_lines + 1)
    head = head.withColumn("line_no", F.row_number().over(Window.orderBy("_f", "_b", "_i"))) \
               .withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > max_lines)
    return head.where(F.col("line_no") <= max_lines).select("value", "line_no", "truncated")


def _ordered_text(header: DataFrame | None, body: DataFrame, order: list[Column], path: str) -> None:
    """Header lines first (kept in given order), then the body by ``order``."""
    b = body.select(F.lit(1).alias("_part"), F.lit(None).cast("bigint").alias("_h"),
                    *[o.alias(f"_k{i}") for i, o in enumerate(order)], F.col("value"))
    if header is not None:
        h = header.select(F.lit(0).alias("_part"), F.col("_hline").alias("_h"), F.col("value"))
        b = h.unionByName(b, allowMissingColumns=True)
    keys = ["_part", "_h"] + [f"_k{i}" for i in range(len(order))]
    b.orderBy(*keys).select("value").write.mode("overwrite").text(path)


def _header(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "_hline bigint, value string")


# ---------------------------------------------------------------- FASTA


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A4: multi-FASTA -> seq_id, description, seq (body lines joined).
    Records are cut at '\\n>' by the line reader, which also handles splits."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    header = F.regexp_extract("value", r"^>?([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^>?[^\n]*\n?", ""), r"\s", "")
    return (raw.where(F.length(F.trim("value")) > 0)
            .select(F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"),
                    F.regexp_replace(header, r"\r$", "").alias("description"),
                    body.alias("seq")))


#: Lines of a file that one window runs over.
LINES = 1 << 16


def carried(lines: DataFrame, values: dict[str, tuple]) -> DataFrame:
    """``lines`` (file, i, ...) with running values along each file, up to
    and including the line: ``values`` maps a name to (F.sum or F.max, column).
    A window runs over LINES lines and starts with what the blocks of lines
    before it give, one row each, so a file is never one task's."""
    x = lines.withColumn(BLK, F.floor(F.col("i") / LINES).cast("bigint"))
    carry = block_carry(x, ["file"], {f"_s{n}": f(c) for n, (f, c) in values.items()},
                        {f"_c{n}": f(F.col(f"_s{n}")).over(before(["file"])) for n, (f, _) in values.items()})
    x = x.join(carry, ["file", BLK], "left")
    w = in_block(["file"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    for n, (f, c) in values.items():
        here, earlier = f(c).over(w), F.col(f"_c{n}")
        x = x.withColumn(n, F.coalesce(here + earlier, here, earlier) if f is F.sum else F.greatest(here, earlier))
    return x.drop(BLK, *(f"_c{n}" for n in values))


def fasta_tiles(spark: SparkSession, path: str, width: int = 1000, overlap: int = 0) -> DataFrame:
    """A4 for long records: (contig, tile, tile_seq), pieces of ``width``
    letters and the ``overlap`` letters after them, as ``genome_tiles`` cuts
    them, straight from the lines of the files.

    A record's start and the letters before each line are carried along the
    file (:func:`carried`), then every line gives its letters to the tiles
    they lie in. So a chromosome is read by all tasks that have a part of its
    file and is never one row; records without letters have no tiles, of
    records of one name in several files the tiles are kept apart by file."""
    lines = cut_lineage(line_index(spark.read.text(path)))
    head = F.col("value").startswith(">")
    lines = lines.withColumns({"_head": head, "_seq": F.when(head, F.lit("")).otherwise(F.regexp_replace("value", r"\s", ""))})
    placed = carried(lines, {"_rec": (F.max, F.when(F.col("_head"), F.col("i"))), "_end": (F.sum, F.length("_seq").cast("bigint"))})
    heads = placed.where("_head").select("file", "_rec", F.col("_end").alias("_from"), F.regexp_extract("value", r"^>(\S*)", 1).alias("contig"))
    body = placed.where("length(_seq) > 0").join(heads, ["file", "_rec"])
    at = F.col("_end") - F.length("_seq") - F.col("_from")
    last = F.col("_end") - F.col("_from") - 1
    first = F.greatest(F.floor((F.col("_at") - overlap) / width), F.lit(0))
    pieces = body.withColumns({"_at": at, "_last": last}).withColumn("tile", F.explode(F.sequence(first.cast("bigint"), F.floor(F.col("_last") / width).cast("bigint"))))
    start = F.greatest(F.col("tile") * width - F.col("_at"), F.lit(0))
    stop = F.least((F.col("tile") + 1) * width + overlap, F.col("_last") + 1) - F.col("_at")
    pieces = pieces.select("file", "_rec", "contig", "tile", (F.col("_at") + start).alias("_p"),
                           F.substring("_seq", (start + 1).cast("int"), (stop - start).cast("int")).alias("_t")).where("length(_t) > 0")
    return pieces.groupBy("file", "_rec", "contig", "tile").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "").alias("tile_seq")) \
        .select("contig", F.col("tile").cast("int").alias("tile"), "tile_seq")


def write_fasta(df: DataFrame, path: str, width: int = 60, id_col: str = "seq_id",
                seq_col: str = "seq", description: str | None = None) -> None:
    """One record per row, sequence wrapped at ``width``, ordered by id."""
    head = F.concat(F.lit(">"), F.col(id_col).cast("string"),
                    F.concat(F.lit(" "), F.col(description)) if description else F.lit(""))
    wrapped = F.regexp_replace(F.col(seq_col), f"(.{{{width}}})(?=.)", "$1\n")
    body = df.select(F.col(id_col).alias("_id"),
                     F.when(F.length(seq_col) > 0, F.concat(head, F.lit("\n"), wrapped))
                     .otherwise(head).alias("value"))
    _ordered_text(None, body, [F.col("_id")], path)


# ---------------------------------------------------------------- FASTQ


def line_index(lines: DataFrame) -> DataFrame:
    """Add ``file`` and ``i``: the 0-based line number inside its file,
    computed JVM-side for any split layout.

    Each file split (``_metadata.file_block_start``) is read by one task in
    order, so ``monotonically_increasing_id`` minus the split's smallest id
    is the line's rank in the split; per-split line counts (one row per
    split) are prefix-summed along the file into offsets. No data reaches
    the driver and split order across partitions does not matter."""
    x = lines.select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_mid"))
    blocks = x.groupBy("file", "_b").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.join(blocks.select("file", "_b", "_m0", "_off"), ["file", "_b"]) \
            .withColumn("i", F.col("_off") + F.col("_mid") - F.col("_m0")).drop("_b", "_mid", "_m0", "_off")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """A5: 4-line records -> read_id, seq, qual (and the record's ordinal).

    Lines get a global index (:func:`line_index`); record = index div 4,
    field = index mod 4, then one aggregation puts the four lines together.
    Quality lines may start with '@', so the file is never split on '\\n@'."""
    idx = line_index(spark.read.text(path))
    rec = F.floor(F.col("i") / 4).cast("bigint")
    g = idx.groupBy("file", rec.alias("record")).agg(
        F.max(F.when(F.col("i") % 4 == 0, F.col("value"))).alias("h"),
        F.max(F.when(F.col("i") % 4 == 1, F.col("value"))).alias("seq"),
        F.max(F.when(F.col("i") % 4 == 3, F.col("value"))).alias("qual"))
    return g.select("file", "record", F.regexp_extract("h", r"^@(\S*)", 1).alias("read_id"), "seq", "qual")


def write_fastq(df: DataFrame, path: str, id_col: str = "read_id") -> None:
    body = df.select(F.col(id_col).alias("_id"), F.col("seq").alias("_s"),
                     F.concat_ws("\n", F.concat(F.lit("@"), F.col(id_col)), F.col("seq"),
                                 F.lit("+"), F.col("qual")).alias("value"))
    _ordered_text(None, body, [F.col("_id"), F.col("_s")], path)


# ---------------------------------------------------------------- SAM


def read_sam(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Header lines (@) dropped; 11 mandatory columns, ``tags`` (name ->
    value) and ``tag_types`` (name -> SAM type letter)."""
    f = F.split(F.col("value"), "\t")
    df = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))

    def tag_map(part: str) -> Column:
        entries = F.map_from_entries(F.transform(
            F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(1))),
            lambda t: F.struct(F.split(t, ":").getItem(0).alias("k"), F.regexp_extract(t, part, 1).alias("v"))))
        return F.when(F.size(f) > 11, entries).otherwise(F.create_map().cast("map<string,string>"))

    out = df.select(
        f.getItem(0).alias("qname"), f.getItem(1).cast("int").alias("flag"),
        f.getItem(2).alias("contig"), f.getItem(3).cast("bigint").alias("pos"),
        f.getItem(4).cast("int").alias("mapq"), f.getItem(5).alias("cigar"),
        f.getItem(6).alias("rnext"), f.getItem(7).cast("bigint").alias("pnext"),
        f.getItem(8).cast("bigint").alias("tlen"), f.getItem(9).alias("seq"),
        f.getItem(10).alias("qual"),
        tag_map(r"^[^:]*:[^:]*:(.*)$").alias("tags"), tag_map(r"^[^:]*:([^:]*):").alias("tag_types"))
    if sample is not None:
        out = out.withColumn("sample", F.lit(sample))
    return out


SAM_COLS = ["qname", "flag", "contig", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def write_sam(df: DataFrame, path: str, contigs: list[tuple[str, int]] | None = None) -> None:
    """@HD/@SQ header then records in coordinate order: contigs as in
    ``contigs``, then others by name, then unplaced reads. Missing optional
    columns are written as SAM placeholders; tags have the types of
    ``tag_types``, else Z."""
    spark = df.sparkSession
    defaults = {"qname": F.lit("*"), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0),
                "seq": F.lit("*"), "qual": F.lit("*"), "mapq": F.lit(255)}
    cols = [F.col(c).cast("string") if c in df.columns else defaults[c].cast("string") for c in SAM_COLS]
    line = F.concat_ws("\t", *cols)
    if "tags" in df.columns:
        kind = (lambda k: F.coalesce(F.try_element_at("tag_types", k), F.lit("Z"))) if "tag_types" in df.columns \
            else (lambda k: F.lit("Z"))
        tag_txt = F.array_join(F.transform(F.map_entries("tags"),
                                           lambda e: F.concat_ws(":", e["key"], kind(e["key"]), e["value"])), "\t")
        line = F.when(F.size("tags") > 0, F.concat_ws("\t", line, tag_txt)).otherwise(line)
    header = ["@HD\tVN:1.6\tSO:coordinate"] + [f"@SQ\tSN:{n}\tLN:{ln}" for n, ln in (contigs or [])]
    listed = F.array(*[F.lit(n) for n, _ in contigs or []]).cast("array<string>")
    place = F.array_position(listed, F.col("contig")).cast("int")
    rank = (F.when(F.col("contig").isNull() | (F.col("contig") == "*"), F.lit(2))
            .when(place > 0, F.lit(0)).otherwise(F.lit(1)))
    body = df.select(rank.alias("_r"), F.when(rank == 0, place).otherwise(0).alias("_n"), F.col("contig").alias("_c"),
                     F.col("pos").alias("_p"), line.alias("value"))
    _ordered_text(_header(spark, header), body, [F.col(c) for c in ("_r", "_n", "_c", "_p", "value")], path)


# ---------------------------------------------------------------- VCF


def parse_vcf_lines(lines: DataFrame, samples: list[str] | Column | None = None) -> DataFrame:
    """VCF body lines (``value``) -> typed records; '#' lines are dropped.
    Works on batch and streaming DataFrames alike. ``samples`` are the names
    in the order of the columns, or an array column of them. Trailing
    genotype fields that a sample leaves out are null; of an INFO key given
    twice the first value counts."""
    if not isinstance(samples, Column):
        samples = F.array(*[F.lit(x) for x in samples or []]).cast("array<string>")
    f = F.split(F.col("value"), "\t")
    body = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    fmt = F.array_distinct(F.split(F.get(f, F.lit(8)), ":"))

    def fields(i: Column) -> Column:
        values = F.split(F.get(f, F.lit(9) + i), ":")
        return F.map_from_arrays(fmt, F.transform(fmt, lambda _, j: F.get(values, j)))

    gts = F.transform(samples, lambda name, i: F.struct(name.alias("sample"), fields(i).alias("fields")))
    info = F.get(f, F.lit(7))
    pairs = F.transform(F.filter(F.split(info, ";"), lambda x: x != ""), lambda x: F.split(x, "=", 2))
    keys = F.transform(pairs, lambda x: x[0])
    values = F.transform(pairs, lambda x: F.get(x, F.lit(1)))
    info_map = F.map_from_arrays(F.array_distinct(keys), F.transform(
        F.array_distinct(keys), lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)))
    return body.select(
        f.getItem(0).alias("contig"), f.getItem(1).cast("bigint").alias("pos"),
        F.when(f.getItem(2) != ".", f.getItem(2)).alias("id"), f.getItem(3).alias("ref"),
        F.split(f.getItem(4), ",").alias("alts"), f.getItem(5).try_cast("double").alias("qual"),
        f.getItem(6).alias("filter"),
        F.when((info == ".") | info.isNull(), F.create_map().cast("map<string,string>"))
         .otherwise(info_map).alias("info"),
        gts.alias("genotypes"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """A7: '#' lines dropped; '.' QUAL -> null; INFO -> map (flag keys map
    to null: test with ``map_contains_key``); samples -> array of
    struct<sample, fields map>. Sample names come from the '#CHROM' line of
    the record's own file: at most two distinct header lines are read to the
    driver, and if files differ the names are joined by file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    heads = text.where(F.col("value").startswith("#CHROM"))
    names = F.split("value", "\t")
    names = F.when(F.size(names) > 9, F.slice(names, 10, F.greatest(F.size(names) - 9, F.lit(1)))) \
        .otherwise(F.array().cast("array<string>"))
    kinds = [r[0] for r in heads.select(names.alias("s")).distinct().limit(2).collect()]
    if len(kinds) < 2:
        return parse_vcf_lines(text, list(kinds[0]) if kinds else [])
    by_file = heads.select("_file", names.alias("_samples")).dropDuplicates(["_file"])
    body = text.where(~F.col("value").startswith("#"))
    return parse_vcf_lines(body.join(by_file, "_file", "left"), F.coalesce(F.col("_samples"), F.array().cast("array<string>")))


def write_vcf(df: DataFrame, path: str, info_cols: list[str] | None = None,
              contigs: list[tuple[str, int]] | None = None) -> None:
    """VCF 4.2 header then records ordered by (contig, pos). ``info_cols``
    are written as INFO key=value pairs (null values skipped), else an
    ``info`` map as it is (null values are flags). ``genotypes`` (see
    :func:`read_vcf`) become FORMAT and one column a sample: the fields of a
    record's first sample, null as '.'; a sample that a record does not have
    is '.'. Sample names are the only thing that reaches the driver."""
    spark = df.sparkSession
    info_cols = info_cols or []
    alt = F.array_join("alts", ",") if "alts" in df.columns else F.col("alt")
    if info_cols or "info" not in df.columns:
        info = F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(c.upper() + "="), F.col(c).cast("string")))
                                  for c in info_cols]) if info_cols else F.lit("")
    else:
        info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat(
            e["key"], F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("")))), ";")
    qual = F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit("."))
    columns = ["contig", F.col("pos").cast("string"),
               F.coalesce(F.col("id"), F.lit(".")) if "id" in df.columns else F.lit("."),
               "ref", alt, qual, F.coalesce(F.col("filter"), F.lit(".")),
               F.when(info == "", F.lit(".")).otherwise(F.coalesce(info, F.lit(".")))]
    names: list[str] = []
    if "genotypes" in df.columns:
        layouts = [r[0] for r in df.select(F.col("genotypes.sample")).where("size(sample) > 0").distinct().limit(2).collect()]
        names = list(layouts[0]) if len(layouts) == 1 else sorted(
            r[0] for r in df.select(F.explode("genotypes.sample").alias("s")).distinct().collect())
    if names:
        keys = F.map_keys(F.col("genotypes")[0]["fields"])
        has = F.coalesce(F.size("genotypes") > 0, F.lit(False))

        def of(name: str) -> Column:
            one = F.filter("genotypes", lambda g: g["sample"] == name)
            fields = F.get(one, F.lit(0))["fields"]
            text = F.array_join(F.transform(keys, lambda k: F.coalesce(F.try_element_at(fields, k), F.lit("."))), ":")
            return F.when(has & (F.size(one) > 0), text).otherwise(F.lit("."))

        columns += [F.when(has, F.array_join(keys, ":")).otherwise(F.lit(".")), *(of(n) for n in names)]
    header = ["##fileformat=VCFv4.2"] + [f"##contig=<ID={n},length={ln}>" for n, ln in (contigs or [])] \
        + [f"##INFO=<ID={c.upper()},Number=1,Type=String,Description=\"{c}\">" for c in info_cols] \
        + ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *names] if names else [])])]
    body = df.select(F.col("contig").alias("_c"), F.col("pos").alias("_p"), F.concat_ws("\t", *columns).alias("value"))
    _ordered_text(_header(spark, header), body, [F.col("_c"), F.col("_p"), F.col("value")], path)


# ---------------------------------------------------------------- BED / GFF


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3/6/narrowPeak; track/browser/# lines skipped; missing
    optional columns are null; columns past the 6th in ``extra``."""
    f = F.split(F.col("value"), "\t")
    df = spark.read.text(path).where(
        ~F.col("value").rlike(r"^(track|browser|#)") & (F.length(F.trim("value")) > 0))
    return df.select(
        f.getItem(0).alias("contig"), f.getItem(1).cast("bigint").alias("start_pos"),
        f.getItem(2).cast("bigint").alias("end_pos"), F.get(f, 3).alias("name"),
        F.get(f, 4).try_cast("double").alias("score"), F.get(f, 5).alias("strand"),
        F.slice(f, 7, F.greatest(F.size(f) - 6, F.lit(1))).alias("extra"))


def write_bed(df: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """BED lines ordered by (contig, start, end)."""
    cols = ["contig", "start_pos", "end_pos"] + [c for c in ("name", "score", "strand") if c in df.columns]
    cols += extra or []
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols])
    body = df.select(F.col("contig").alias("_c"), F.col("start_pos").alias("_s"),
                     F.col("end_pos").alias("_e"), line.alias("value"))
    _ordered_text(None, body, [F.col("_c"), F.col("_s"), F.col("_e"), F.col("value")], path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 -> contig, source, feature, start_pos (0-based), end_pos,
    score, strand, phase, attributes map; '#' lines and FASTA tail skipped."""
    f = F.split(F.col("value"), "\t")
    df = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    return df.select(
        f.getItem(0).alias("contig"), f.getItem(1).alias("source"), f.getItem(2).alias("feature"),
        (f.getItem(3).cast("bigint") - 1).alias("start_pos"), f.getItem(4).cast("bigint").alias("end_pos"),
        f.getItem(5).try_cast("double").alias("score"), f.getItem(6).alias("strand"),
        f.getItem(7).try_cast("int").alias("phase"),
        F.str_to_map(F.regexp_replace(f.getItem(8), r";$", ""), F.lit(";"), F.lit("=")).alias("attributes"))


def write_gff(df: DataFrame, path: str) -> None:
    """GFF3 with a version header, ordered by (contig, start)."""
    spark = df.sparkSession
    attrs = F.array_join(F.transform(F.map_entries("attributes"),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    line = F.concat_ws("\t", "contig", F.coalesce("source", F.lit(".")), "feature",
                       (F.col("start_pos") + 1).cast("string"), F.col("end_pos").cast("string"),
                       F.coalesce(F.col("score").cast("string"), F.lit(".")),
                       F.coalesce("strand", F.lit(".")),
                       F.coalesce(F.col("phase").cast("string"), F.lit(".")), attrs)
    body = df.select(F.col("contig").alias("_c"), F.col("start_pos").alias("_s"), line.alias("value"))
    _ordered_text(_header(spark, ["##gff-version 3"]), body, [F.col("_c"), F.col("_s"), F.col("value")], path)


# ---------------------------------------------------------------- PDB / PDBQT


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """A10: fixed-width ATOM/HETATM lines -> mol_id (file name), pose_id
    (MODEL count so far, from 1; 1 when no MODEL lines), atom_id, atom name,
    residue, element, x, y, z, charge (PDBQT partial charge when present).
    The MODEL count is carried along the lines of a file (:func:`carried`),
    so a file of very many poses is read by many tasks."""
    raw = carried(line_index(spark.read.text(path)), {"_m": (F.sum, F.col("value").startswith("MODEL").cast("int"))})
    raw = raw.withColumn("pose_id", F.greatest("_m", F.lit(1)))
    atoms = raw.where(F.col("value").rlike("^(ATOM  |HETATM)"))

    def col(a: int, b: int) -> Column:
        return F.trim(F.substring("value", a, b - a + 1))

    elem = F.coalesce(F.when(col(77, 78) != "", col(77, 78)),
                      F.regexp_extract(col(13, 16), r"([A-Za-z])", 1))
    return atoms.select(
        F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("mol_id"),
        F.col("pose_id").cast("int").alias("pose_id"),
        col(7, 11).cast("int").alias("atom_id"), col(13, 16).alias("atom_name"),
        col(18, 20).alias("residue"), F.upper(elem).alias("element"),
        col(31, 38).cast("double").alias("x"), col(39, 46).cast("double").alias("y"),
        col(47, 54).cast("double").alias("z"),
        col(71, 76).try_cast("double").alias("charge"))
