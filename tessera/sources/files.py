"""Directory, file and history sources, and versioned snapshots."""

from __future__ import annotations

import json
import os
import subprocess
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate

#: Folders that are not scanned, besides those whose name begins with a point; fixed values.
SKIP_FOLDERS = ("target", "node_modules", "dist", "build")
#: Extensions that are never text; fixed values.
SKIP_EXTENSIONS = (
    "lock", "tmp", "log", "mp3", "m4a", "aac", "ogg", "wav", "flac", "png", "jpg", "jpeg", "gif", "webp", "svg",
    "zip", "tar", "gz", "7z", "rar", "bin", "dat", "exe", "dll", "so", "dylib", "wasm", "docx", "pptx", "xlsx",
)


def path_allowed(path: Column, skip: tuple[str, ...] = SKIP_FOLDERS) -> Column:
    """Whether no part of a path relative to the root is hidden or a skipped folder."""
    folders = "|".join(skip)
    return ~F.rlike(path, F.lit(rf"(^|/)(\.(?!\.?(/|$))[^/]*|({folders}))(/|$)"))


def category(content: Column, path: Column) -> Column:
    """``Pdf``, ``TextOrCode`` or ``Unsupported`` by first bytes, UTF-8 validity and NUL bytes."""
    starts = lambda hexed: F.substring(content, 1, len(hexed) // 2) == F.unhex(F.lit(hexed))
    magic = starts("25504446")
    other = starts("494433") | starts("89504E470D0A1A0A") | starts("FFD8FF") | starts("504B0304") | starts("52494646") | starts("664C6143") | starts("7F454C46")
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.unhex(F.lit("00")))
    return (
        F.when(magic, "Pdf").when(F.lower(T.extension(path)) == "pdf", "Unsupported").when(other, "Unsupported").when(text, "TextOrCode").otherwise("Unsupported")
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, ext, mtime, length, content, category)`` of the supported files below a folder.

    Hidden and build folders and known binary extensions drop out before any
    content is read; white-space-only text drops out after.
    """
    base = root.rstrip("/")
    plain = base if "://" in base else "file:" + os.path.abspath(base)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^\\Q" + plain.replace("file:///", "file:/") + "\\E/", "")
    named = raw.withColumn("rel", rel).where(path_allowed(F.col("rel"))).withColumn("ext", F.lower(T.extension(F.col("rel")))).where(~F.col("ext").isin(*SKIP_EXTENSIONS))
    out = named.withColumn("category", category(F.col("content"), F.col("rel"))).where("category <> 'Unsupported'")
    out = out.where((F.col("category") == "Pdf") | (F.length(F.trim(F.regexp_replace(F.col("content").cast("string"), r"\s+", " "))) > 0))
    return out.select(F.col("rel").alias("path"), "ext", F.col("modificationTime").alias("mtime"), "length", "content", "category")


def stamps(root: str) -> dict[str, tuple[float, int]]:
    """Modification time and size of the files of a local folder that a scan would look at, without Spark."""
    out = {}
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if not n.startswith(".") and n not in SKIP_FOLDERS]
        for f in files:
            if f.startswith(".") or f.rpartition(".")[2].lower() in SKIP_EXTENSIONS:
                continue
            try:
                at = os.stat(full := os.path.join(folder, f))
            except OSError:
                continue
            out[os.path.relpath(full, root)] = (at.st_mtime, at.st_size)
    return out


def parse_git_log(log: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``(seq, hash, subject, files)`` from lines ``(line_no, line)`` of a log with names; commits without files drop out.

    Lines are numbered by blocks of ``block`` line numbers: the headers of a block
    are counted, the counts of the blocks before are added, so that no task sorts a
    whole log.
    """
    head = F.startswith(F.col("line"), F.lit("COMMIT:"))
    src = log.withColumn("block", F.floor(F.col("line_no") / F.lit(block)))
    per = src.groupBy("block").agg(F.count_if(head).alias("heads"))
    # one row a block
    before = per.withColumn("base", F.coalesce(F.sum("heads").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "base")
    w = Window.partitionBy("block").orderBy("line_no")
    s = src.join(before, "block").withColumn("seq", F.col("base") + F.sum(F.when(head, 1).otherwise(0)).over(w)).where("seq > 0")
    title = s.where(head).select("seq", F.regexp_extract("line", r"^COMMIT:([^|]*)\|", 1).alias("hash"), F.regexp_extract("line", r"^COMMIT:[^|]*\|(.*)$", 1).alias("subject"))
    files = s.where(~head & (F.trim("line") != "")).groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("f")))), lambda x: x["f"]).alias("files"))
    return title.join(files, "seq").select("seq", "hash", "subject", "files")


def git_history(spark: SparkSession, root: str, commits: int = 200) -> DataFrame:
    """Commits of a repository, latest first; no rows where the folder is none."""
    done = subprocess.run(["git", "-C", root, "log", "--name-only", f"-n{commits}", "--pretty=format:COMMIT:%h|%s"], capture_output=True, text=True)
    rows = list(enumerate(done.stdout.split("\n"))) if done.returncode == 0 else []
    return parse_git_log(spark.createDataFrame(rows, "line_no int, line string"))


def fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and labelled queries of a JSON fixture; an error for repeated ids or labels of unknown documents."""
    schema = "documents array<struct<id:string,path:string,content:string,fingerprint_byte:int>>, queries array<struct<id:string,kind:string,text:string,relevance:map<string,int>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    docs = raw.select(F.explode("documents").alias("d")).select("d.*")
    qrels = raw.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), "q.kind", "q.text", F.explode_outer("q.relevance").alias("id", "grade"))
    if docs.isEmpty() or qrels.isEmpty():
        raise ValueError("the fixture has no documents or no queries")
    if not docs.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("the fixture repeats a document id")
    if not qrels.where("id is null").isEmpty() or not evaluate.validate_qrels(qrels, docs).where("problem = 'unknown id'").isEmpty():
        raise ValueError("a query has no labels or labels an unknown document")
    return docs, qrels


def _context(spark: SparkSession):
    """Hadoop's file context, which replaces files atomically where the file system can."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a small file whole: under another name first, then renamed over the old one."""
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
        tmp = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(tmp, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, os.path.join(folder, name))
        return
    fs, jvm = _context(spark), spark.sparkContext._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    tmp = path(f".{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    opts = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0)
    out = fs.create(tmp, flags, opts)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    fs.rename(tmp, path(name), over)


def _get(spark: SparkSession, folder: str, name: str) -> str | None:
    """A small file's text; None where there is none."""
    if "://" not in folder:
        at = os.path.join(folder, name)
        if not os.path.exists(at):
            return None
        with open(at) as f:
            return f.read()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return "\n".join(r[0] for r in spark.read.text(f"{folder}/{name}").collect())


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> str:
    """Write tables as a new version and point to it at last; a failure leaves the old version in force.

    ``folder`` may be a local path or any place that Hadoop's file systems reach.
    """
    version = f"v-{uuid.uuid4().hex}"
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(f"{folder}/{version}/{name}")
    if spark is not None:
        _put(spark, folder, "CURRENT", json.dumps({"version": version, "tables": sorted(tables)}))
    return version


def load_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the version in force; empty where there is none."""
    text = _get(spark, folder, "CURRENT")
    if text is None:
        return {}
    m = json.loads(text)
    return {t: spark.read.parquet(f"{folder}/{m['version']}/{t}") for t in m["tables"]}


def synthetic_vectors(spark: SparkSession, n: int, dim: int = 256, seed: int = 42) -> DataFrame:
    """``(id, vector)``: seeded uniform vectors of length 1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5)
    from ..functions import vectors as V

    return spark.range(n).select("id", raw.alias("v")).select("id", V.normalize(F.col("v")).alias("vector"))


def synthetic_chunks(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.format_string("chunk:%d", "id").alias("id"), F.format_string("file%d.md", "id").alias("file_path"), F.format_string("marker%d vector search document content", "id").alias("content"))
