"""Readers and writers: JSON lines (plain or gzip by content), logs, verdict files, provenance, token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.core import ship


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with source file and row; blank lines are skipped, bad lines keep their text in _corrupt_record.

    ``source_row`` counts the lines of a file in order, blank ones included, from 1.
    """
    t = spark.read.text(path).select("value", F.input_file_name().alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # Lines are numbered within the blocks in which files are read; a block starts behind the lines of those before it.
    blocks = t.groupBy("source_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("source_file", "_block", "_first", "_before")
    t = t.join(blocks, ["source_file", "_block"]).withColumn("source_row", F.col("_before") + F.col("_id") - F.col("_first") + 1).where(F.trim("value") != "")
    parsed = t.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("source_file", "source_row", "r.*", F.when(~F.trim("value").startswith("{"), F.col("value")).alias("_not_object"))


def read_jsonl_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that are gzip or plain by their first two bytes, whatever their names: (source_file, source_row, value).

    Whole files are opened, so a file should fit into a task; many files spread over many tasks.
    """
    ship(spark)

    def lines(batches):
        import gzip

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(i + 1, x) for i, x in enumerate(raw.decode("utf-8").splitlines()) if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())], names=["source_file", "source_row", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "source_file string, source_row long, value string")


def load_cases(cases: DataFrame, domain: str | None = None, default: str = "general") -> DataFrame:
    """(case_id, question, domain, ...) of the cases of a single turn, of one domain if asked for.

    A missing domain is ``default``; an id that comes twice is an error, raised when its row is read.
    """
    c = cases.where(F.col("case_id").isNotNull() & ~F.coalesce(F.col("case_input.multi_turn"), F.lit(False)))
    c = c.withColumn("question", F.col("case_input.question")).withColumn("domain", F.coalesce("metadata.skill_domain", F.lit(default)))
    g = c.groupBy("case_id").agg(F.min_by(F.struct("question", "domain", "metadata"), F.struct("question", "domain")).alias("r"), F.count("*").alias("n"))
    twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("case id comes twice: "), F.col("case_id"))).cast("string")).otherwise(F.col("case_id"))
    out = g.select(twice.alias("case_id"), "r.question", "r.domain", "r.metadata")
    return out if domain is None else out.where(F.col("domain") == domain)


def load_instances(spark: SparkSession, pattern: str, key: str = "iid") -> DataFrame:
    """Union of JSON files of state instances; an instance that several files hold is an error, raised when its row is read."""
    d = spark.read.json(pattern, multiLine=True)
    g = d.groupBy(key).agg(F.min(F.to_json(F.struct(*d.columns))).alias("_r"), F.count("*").alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("instance comes twice: "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("_r"))
    return g.select(F.from_json(once, d.schema).alias("r")).select("r.*")


def parse_training_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed columns of the iteration lines of a training log; other lines are dropped."""
    x = F.col(value)
    num = r"([-+0-9.]+(?:[eE][-+]?\d+)?)"
    get = lambda p, t: F.nullif(F.regexp_extract(x, p, 1), F.lit("")).try_cast(t)
    return lines.where(x.contains("lm loss:")).select(
        *[c for c in lines.columns if c != value],
        get(r"iteration\s+(\d+)\s*/", "long").alias("step"),
        get(r"iteration\s+\d+\s*/\s*(\d+)", "long").alias("planned_steps"),
        get(r"consumed samples:\s*(\d+)", "long").alias("consumed"),
        get(rf"lm loss:\s*{num}", "double").alias("loss"),
        get(rf"learning rate:\s*{num}", "double").alias("learning_rate"),
        get(rf"grad norm:\s*{num}", "double").alias("grad_norm"),
        get(r"skipped iterations:\s*(\d+)", "long").alias("skipped"),
        get(r"nan iterations:\s*(\d+)", "long").alias("nan"),
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation run files with a nested ``cases`` list -> (source_file, item_id, verdict), scores before results."""
    from tracelake.functions.text import verdict

    schema = "cases array<struct<item_id: string, scores: array<struct<name: string, stringValue: string, value: string>>, eval_result: string>>"
    c = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("source_file"), F.explode("cases").alias("c"))
    score = F.try_element_at(F.filter("c.scores", lambda s: verdict(F.coalesce(s["stringValue"], s["value"])).isNotNull()), F.lit(1))
    return c.select("source_file", "c.item_id", F.coalesce(verdict(F.coalesce(score["stringValue"], score["value"])), verdict(F.col("c.eval_result"))).alias("verdict"))


def file_provenance(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file; contents are hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def known_sources(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose fingerprint is not on the list of known sources."""
    return files.join(known.select("sha256").distinct(), "sha256", "left_anti")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, nulls written out."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a header and a fixed list of fields."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_token_table(samples: DataFrame, path: str) -> None:
    """Token and mask arrays with the exclusive offset of each sample in sample order."""
    from tracelake.operators.joins import running_total

    sized = samples.withColumn("length", F.size("tokens").cast("long"))
    out = running_total(sized, ["sample_id"], "length", "upto")
    out.select("sample_id", "tokens", "mask", "length", (F.col("upto") - F.col("length")).alias("offset")).write.mode("overwrite").parquet(path)
