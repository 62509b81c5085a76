"""Reading and writing the engine's relations: JSON lines with explicit schemas and parse modes, Parquet, scratch tables."""

from __future__ import annotations

import atexit
import gc
import json
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mixlens.sources import versions

SOURCE = "instruction string, input string, output string"
INFERENCE = (
    "model_name string, model_id string, sample_id string, level int, category string, prompt string, response string, "
    "success boolean, tokens_used int, latency_ms long, error string, error_type string"
)
CONSTRAINT_IN = "struct<constraint_type:string,requirement:string,verification_regex:string,target_value:string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session, as in tests; on a cluster each executor would write to
    a disk of its own, so it raises there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="mixlens-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_root(spark)}/mixlens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back; by names a column with a folder for each value.

    This cuts the lineage: a lost executor costs the tasks it ran, not what came before.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    # shuffle files of finished stages go when the driver's JVM finds them unreachable, which else may take half an hour
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of stored() that no later step reads, through the file system that holds them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for part in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(part)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read_lines(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines. strict raises at a bad line; resume does, too, but takes a missing path for empty; lenient drops bad
    lines; marked keeps them in _corrupt_record.

    A missing path is an empty relation, but for the strict mode. Of a path that was replaced the last version is read.
    """
    wanted, path = StructType.fromDDL(schema), versions.current(spark, path)
    if mode != "strict" and not exists(spark, path):
        return spark.createDataFrame([], wanted)
    if mode in ("strict", "resume"):
        return spark.read.schema(wanted).json(path, mode="FAILFAST")
    if mode == "lenient":
        return spark.read.schema(wanted).json(path, mode="DROPMALFORMED")
    marked = StructType([*wanted.fields]).add("_corrupt_record", "string")
    return spark.read.schema(marked).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and line, from 1, of each line that is no record of the schema; blank lines are skipped, but count.

    Every split of a file counts its lines, and the lines of the splits before are added; no task reads a whole file.
    """
    text = spark.read.text(versions.current(spark, path)).withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "id": F.monotonically_increasing_id()})
    parsed = F.from_json("value", StructType.fromDDL(schema).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    told = text.withColumn("bad", (F.trim("value") != "") & (parsed.isNull() | parsed["_bad"].isNotNull() | F.get_json_object("value", "$").isNull()))
    wrong = told.filter("bad").select("file", "block", "id")
    # the lines of a split have numbers that follow each other, in a split's task; a row for each split
    splits = text.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return wrong.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; a bad line raises ValueError with its file and number, the first of up to ten."""
    if found := bad_lines(spark, path, schema).orderBy("file", "line").limit(10).collect():
        raise ValueError("malformed JSON at " + ", ".join(f"{r.file}:{r.line}" for r in found))
    return read_lines(spark, path, schema)


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Good records, their distinct keys, and how many lines were bad; a missing path has none of these."""
    rows = read_lines(spark, path, schema, "marked")
    if "_corrupt_record" not in rows.columns:
        return rows, rows.select(*key), 0
    kept = stored(rows, "checkpoint")
    good = kept.filter("_corrupt_record IS NULL").drop("_corrupt_record")
    return good, good.select(*key).distinct(), kept.filter("_corrupt_record IS NOT NULL").count()


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Add where a row of files read as they are stands: its file, its block, and its place there."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("place"))
    return df.select("*", place.alias(name))


def load_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """One split of a data set exported to a folder: parquet below path/split, else JSON lines, else the whole path as parquet."""
    path = versions.current(spark, path)
    for at, kind in ((f"{path}/{split}", "parquet"), (f"{path}/{split}.parquet", "parquet"), (f"{path}/{split}.jsonl", "json"), (path, "parquet")):
        if exists(spark, at):
            return spark.read.format(kind).load(at)
    raise FileNotFoundError(path)


def load_lexicon(path: str) -> list[tuple[str, str]]:
    """Pairs of a JSON object in its order, without those that map a word to itself; a missing file has none."""
    if not Path(path).exists():
        return []
    return [(k, v) for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items() if k != v]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, raw UTF-8. An overwrite is a new version of the path, which read_lines finds; other modes write in place."""
    if mode == "overwrite":
        versions.replace(df, path)
    else:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append JSON lines of which each task's are in place as soon as the task ends, whatever becomes of the job.

    The committer of the second kind moves a task's file when the task commits. A task run again replaces its own file, so
    no line comes twice. This holds where a rename is atomic, as on HDFS or a local disk.
    """
    df.write.mode("append").option("ignoreNullFields", "false").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def write_failures(failures: DataFrame, path: str) -> dict[str, int]:
    """Failed rows as JSON lines; returns how many there are of each error_type. No failures leave no file."""
    counts = {r.error_type or "unknown": r["count"] for r in failures.groupBy("error_type").count().collect()}
    if counts:
        write_lines(failures, path)
    return counts


def write_stats(spark: SparkSession, stats: dict, path: str) -> None:
    """Figures of a run as one JSON object."""
    write_report(spark.createDataFrame([(json.dumps(stats, ensure_ascii=False),)], "value string"), path, "text")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report as one file."""
    df.coalesce(1).write.mode("overwrite").format(kind).save(path)


def export_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet folders train and test."""
    for part in ("train", "test"):
        df.filter(F.col(split) == part).drop(split).write.mode("overwrite").parquet(f"{path}/{part}")


def typed_constraints(raw: F.Column) -> F.Column:
    """Constraints as read, with target_value as JSON text, into typed ones: a list of words, two bounds, or a format."""
    kind = lambda c: c["constraint_type"]
    value = lambda c: c["target_value"]
    bounds = lambda c, k, name: F.coalesce(F.get_json_object(value(c), f"$[{k}]"), F.get_json_object(value(c), f"$.{name}")).cast("long")
    return F.transform(
        raw,
        lambda c: F.struct(
            kind(c).alias("constraint_type"),
            c["requirement"].alias("requirement"),
            c["verification_regex"].alias("verification_regex"),
            F.when(kind(c) == "keyword", F.from_json(value(c), "array<string>")).alias("keywords"),
            F.when(kind(c) == "length", bounds(c, 0, "min")).alias("min_words"),
            F.when(kind(c) == "length", bounds(c, 1, "max")).alias("max_words"),
            F.when(kind(c) == "format", value(c)).alias("format_id"),
        ),
    )


def load_config(path: str) -> dict:
    """A YAML or JSON file; a missing one raises FileNotFoundError."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def load_templates(path: str, needed: tuple[str, ...] = ("shared", "level_0", "level_1", "level_2", "level_3")) -> dict:
    found = load_config(path)
    if missing := [k for k in needed if k not in found]:
        raise ValueError(f"{path} lacks {missing}")
    return found


def environment_value(key: str, default: str | None = None, required: bool = False) -> str | None:
    import os

    found = os.environ.get(key, default)
    if required and not found:
        raise ValueError(f"{key} is not set")
    return found


def demo_rows(spark: SparkSession) -> DataFrame:
    """Ten literal instructions with answers, two of each category."""
    rows = [
        ("Jika semua burung bertelur dan merpati adalah burung, apa kesimpulannya?", "logical_reasoning", "Merpati bertelur, karena merpati termasuk burung dan semua burung bertelur."),
        ("Jika lampu menyala maka ada listrik. Listrik padam. Apakah lampu menyala?", "logical_reasoning", "Lampu tidak menyala, sebab tanpa listrik lampu tidak dapat menyala."),
        ("Hitung jumlah dari 12 dan 30.", "mathematical_reasoning", "Jumlah dari 12 dan 30 adalah 42."),
        ("Berapa persen 15 dari 60?", "mathematical_reasoning", "Nilai 15 adalah 25 persen dari 60."),
        ("Tulis cerita pendek tentang perahu kecil.", "creative_writing", "Sebuah perahu kecil menyusuri sungai saat fajar dan pulang membawa ikan."),
        ("Tulis puisi tentang hujan sore.", "creative_writing", "Hujan sore mengetuk jendela, membawa harum tanah basah."),
        ("Sebutkan tiga fakta tentang bulan.", "information_extraction", "Bulan mengelilingi bumi, memantulkan cahaya matahari, dan memengaruhi pasang laut."),
        ("Rangkum manfaat membaca setiap hari.", "information_extraction", "Membaca menambah pengetahuan, melatih ingatan, dan memperluas kosakata."),
        ("Buat fungsi python untuk menjumlahkan daftar angka.", "coding", "def jumlah(angka):\n    return sum(angka)"),
        ("Buat script javascript untuk mencetak isi array.", "coding", "for (const isi of daftar) console.log(isi);"),
    ]
    return spark.createDataFrame(rows, "instruction string, category string, output string")


def demo_dataset(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn from the demo rows by a hash, numbered so that each instruction is unique, with constraints and levels."""
    from mixlens.operators.build import finished

    listed = [r.asDict() for r in demo_rows(spark).collect()]
    every = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.items())) for r in listed))
    picked = spark.range(n).withColumn("_r", F.element_at(every, (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(listed))) + 1).cast("int")))
    numbered = F.concat(F.col("_r.instruction"), F.lit(" (Variasi "), (F.col("id") + 1).cast("string"), F.lit(")"))
    rows = picked.select(numbered.alias("instruction"), F.lit("").alias("input"), F.col("_r.output").alias("output"), F.col("_r.category").alias("category"))
    return finished(rows, seed)
