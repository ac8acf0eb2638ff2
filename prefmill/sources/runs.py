"""Readers and writers: typed CSV with encoding fallback, report bundles, run discovery, appending sinks, metadata."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import time
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed names of the reports of a run.
REPORTS = ("epochs", "steps", "alerts", "confusion", "class_report")
EPOCHS = "time string, epoch int, mean_train_loss double, val_loss double, val_acc double, macro_f1 double"
STEPS = "time string, epoch int, step int, global_step int, lr double, loss double, grad_norm double, gpu_mem_mb double"
ALERTS = "time string, epoch int, type string, value string, note string"
RAW = "id long, model_a string, model_b string, prompt string, response_a string, response_b string, winner_model_a int, winner_model_b int, winner_tie int"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A report with quoted line breaks, one task a file; a schema spares the pass that infers one. Large tables are for
    quoted.read_quoted(), which splits files."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_guarded(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path.rsplit("/", 1)[-1])
    return read_csv(spark, path, schema)


def read_lenient(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """None if the file is missing or can't be read; Latin-1 where a line isn't UTF-8."""
    if not exists(spark, path):
        return None
    try:
        valid = spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()
        df = read_csv(spark, path, schema, "UTF-8" if valid else "ISO-8859-1")
        df.isEmpty()  # what can't be read shows here, not in the caller's first action
        return df
    except PySparkException:
        return None


def read_strict(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Latin-1 where a line isn't UTF-8, like read_lenient(); what is missing or can't be read raises an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path.rsplit("/", 1)[-1])
    valid = spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()
    df = read_csv(spark, path, schema, "UTF-8" if valid else "ISO-8859-1")
    df.isEmpty()
    return df


_CACHED: dict[str, DataFrame] = {}


def read_cached(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """read_lenient(), kept by path until clear_cached()."""
    if path not in _CACHED and (df := read_lenient(spark, path, schema)) is not None:
        _CACHED[path] = df.persist()
    return _CACHED.get(path)


def clear_cached() -> int:
    n = len(_CACHED)
    while _CACHED:
        _CACHED.popitem()[1].unpersist()
    return n


#: Reports whose columns are fixed.
TYPED = {"epochs": EPOCHS, "steps": STEPS, "alerts": ALERTS}


def load_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A report with its fixed columns, where it has some; a missing one is empty."""
    df = read_lenient(spark, f"{folder}/{name}.csv", TYPED.get(name))
    return df if df is not None else spark.createDataFrame([], TYPED.get(name, "time string"))


def load_bundle(spark: SparkSession, folder: str, names=REPORTS) -> dict[str, DataFrame | None]:
    return {n: read_lenient(spark, f"{folder}/{n}.csv") for n in names}


def from_records(spark: SparkSession, data: bytes, schema: str) -> DataFrame:
    """Rows of an uploaded CSV."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"))))
    strings = spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))
    types = {f.split()[0]: f.split()[1] for f in schema.split(", ")}
    return strings.select(*(F.expr(f"try_cast(`{c}` as {types.get(c, 'string')})").alias(c) for c in rows[0]))


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(suffix)) if fs.exists(p) else []


def list_runs(spark: SparkSession, results: str, reports: str | None = None) -> DataFrame:
    """run, ts, results_dir, reports_dir of run_YYYYMMDD_HHMMSS folders, newest first; reports_dir is null if missing."""

    def folders(root: str) -> list[tuple[str, str]]:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    a = spark.createDataFrame(folders(results), "run string, results_dir string")
    b = spark.createDataFrame(folders(reports) if reports else [], "run string, reports_dir string")
    ts = F.try_to_timestamp(F.nullif(F.regexp_extract("run", r"^run_(\d{8}_\d{6})$", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
    return a.join(b, "run", "left").withColumn("ts", ts).filter("ts is not null").orderBy(F.desc("ts"))


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_reports(frames: dict[str, DataFrame], folder: str, prefix: str = "") -> None:
    for name, df in frames.items():
        write_csv(df, f"{folder}/{prefix}{name}")


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file from any file system; None if there is none."""
    if not exists(spark, path):
        return None
    return b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).select("content").collect())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads((read_bytes(spark, path) or b"").decode() or "{}")


def write_json(spark: SparkSession, path: str, values: dict) -> None:
    write_bytes(spark, path, json.dumps(values, ensure_ascii=False, indent=2).encode())


def read_yaml(spark: SparkSession, *paths: str) -> dict:
    """The first of the files that exists, as YAML if that library is there, else as JSON."""
    for path in paths:
        if (data := read_bytes(spark, path)) is not None:
            try:
                import yaml
            except ImportError:
                return json.loads(data or b"{}")
            return yaml.safe_load(data) or {}
    return {}


def write_yaml(spark: SparkSession, path: str, values: dict) -> None:
    """YAML if that library is there; else JSON, which YAML readers take too."""
    try:
        import yaml
    except ImportError:
        return write_json(spark, path, values)
    write_bytes(spark, path, yaml.safe_dump(values, allow_unicode=True, sort_keys=False).encode())


def write_metadata(spark: SparkSession, path: str, values: dict) -> dict:
    """Read, update and write one JSON document."""
    new = read_json(spark, path) | values
    write_json(spark, path, new)
    return new


def write_eda_metadata(spark: SparkSession, path: str, source: str, folders: dict[str, str], tables) -> dict:
    """When, from what, where to and which tables were made."""
    made = {"created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "source": source, "tables": sorted(tables)}
    return write_metadata(spark, path, made | folders)


def _lines(rows: list[dict], columns) -> str:
    out = io.StringIO()
    writer = csv.DictWriter(out, columns, lineterminator="\n", extrasaction="ignore")
    writer.writerows(rows)
    return out.getvalue()


#: Seconds that a writer waits for another one's append.
PATIENCE = 60


class _Files:
    """A path's file system, through the JVM; bytes go from stream to stream there."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)

    def beside(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path.getParent(), f".{self.path.getName()}.{name}")

    def copy(self, source, out) -> None:
        into = self.fs.open(source)
        try:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, self.conf, False)
        finally:
            into.close()

    def first_line(self) -> str:
        into = self.fs.open(self.path)
        try:
            reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(into, "UTF-8"))
            return reader.readLine() or ""
        finally:
            into.close()

    @contextlib.contextmanager
    def staged(self):
        """A stream whose bytes become the file when the block ends without an error, all at once."""
        self.fs.mkdirs(self.path.getParent())
        staged = self.beside(uuid.uuid4().hex)
        out = self.fs.create(staged, True)
        try:
            yield out
            out.close()
            over = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            self.jvm.java.lang.reflect.Array.set(over, 0, getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(staged, self.path, over)
        except BaseException:
            out.close()
            self.fs.delete(staged, False)
            raise

    @contextlib.contextmanager
    def alone(self):
        """One writer at a time: a lock file, which only one can create, beside the file."""
        self.fs.mkdirs(self.path.getParent())
        lock, end = self.beside("lock"), time.monotonic() + PATIENCE
        while True:
            try:
                self.fs.create(lock, False).close()
                break
            except Py4JJavaError:
                if time.monotonic() > end:
                    raise TimeoutError(f"{lock} is held: remove it if its writer has died") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            self.fs.delete(lock, False)


def write_sheet(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a byte order mark, for spreadsheets. Tasks write its parts; the file system's streams
    join them, in order, behind one header, and the file appears when it is whole."""
    files = _Files(df.sparkSession, path)
    parts = files.beside(f"parts-{uuid.uuid4().hex}")
    try:
        df.write.option("header", False).option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(parts.toString())
        found = sorted((x.getPath() for x in files.fs.listStatus(parts)), key=lambda x: x.getName())
        with files.staged() as out:
            out.write(bytearray(("\ufeff" + _lines([dict(zip(df.columns, df.columns))], df.columns)).encode()))
            for part in (x for x in found if x.getName().startswith("part-")):
                files.copy(part, out)
    finally:
        files.fs.delete(parts, True)


def _append(spark: SparkSession, path: str, text) -> None:
    """text(first line, or None if there is no file) at the end of a file, or not at all."""
    files = _Files(spark, path)
    with files.alone():
        there = files.fs.exists(files.path)
        more = text(files.first_line() if there else None)
        with files.staged() as out:
            if there:
                files.copy(files.path, out)
            out.write(bytearray(more.encode()))


def append_rows(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Rows of the driver's own (epochs, steps) at the end of one CSV file, with one header, of its first row's columns.
    Several writers may append; an append that fails leaves the file as it was."""
    if not rows:
        return

    def text(header: str | None) -> str:
        columns = next(csv.reader([header])) if header else list(rows[0])
        return ("" if header else _lines([dict(zip(columns, columns))], columns)) + _lines(rows, columns)

    _append(spark, path, text)


def append_log(spark: SparkSession, path: str, section: str, lines) -> None:
    """Lines of a section at the end of a text log."""
    _append(spark, path, lambda _: "".join(f"{x}\n" for x in (f"[{section}]", *lines)))


def run_by_name(runs: DataFrame, name: str):
    """The row of a run; None if there is none."""
    return runs.filter(F.col("run") == name).first()


def ready(spark: SparkSession, folder: str, needed=("model.json",)) -> bool:
    """Whether a run's folder has all files that serving needs."""
    return all(exists(spark, f"{folder}/{n}") for n in needed)


def catalog_runs(spark: SparkSession, results: dict[str, str], reports: dict[str, str] | None = None, needed=("model.json",)) -> DataFrame:
    """model, run, ts, results_dir, reports_dir, ready of the runs of every model, newest first."""
    rows = [(model, r["run"], r["ts"], r["results_dir"], r["reports_dir"], ready(spark, r["results_dir"], needed)) for model, root in results.items() for r in list_runs(spark, root, (reports or {}).get(model)).collect()]
    return spark.createDataFrame(rows, "model string, run string, ts timestamp, results_dir string, reports_dir string, ready boolean").orderBy("model", F.desc("ts"))


def enabled_models(config: dict) -> list[str]:
    """Names of the models of a configuration that are not switched off."""
    return [name for name, m in config.get("models", {}).items() if (m or {}).get("enabled", True)]


#: Fixed names of the stages that leave a marker.
STAGES = ("CleaningDone", "SummaryDone", "SummaryTrainValid", "EdaDone", "EdaAnalysisDone")


class Markers:
    """Files that say which stages are done. They don't depend on what the input holds, so a changed input needs force."""

    def __init__(self, spark: SparkSession, folder: str, names=STAGES):
        self.spark, self.folder, self.names = spark, folder, names

    def path(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(name)
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return exists(self.spark, self.path(name))

    def create(self, name: str, content: str = "") -> None:
        write_bytes(self.spark, self.path(name), content.encode())

    def remove(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, False)

    def once(self, name: str, stage, force: bool = False) -> bool:
        """Runs stage() and leaves the marker, unless it is there; says whether it ran."""
        if self.exists(name) and not force:
            return False
        stage()
        self.create(name)
        return True


def validate(config: dict, schema: dict) -> dict:
    """config with values made the types of schema: {key: (type, default or ... if needed, choices or None)}; a nested
    dict is a section. Unknown and missing keys and values outside their choices are errors, named by their dotted key."""
    out, errors = {}, []

    def walk(values: dict, kinds: dict, into: dict, at: str) -> None:
        errors.extend(f"unknown key {at}{k}" for k in values if k not in kinds)
        for k, kind in kinds.items():
            if isinstance(kind, dict):
                walk(values.get(k) or {}, kind, into.setdefault(k, {}), f"{at}{k}.")
                continue
            of, default, choices = kind
            if k not in values and default is ...:
                errors.append(f"missing key {at}{k}")
                continue
            v = values.get(k, default)
            try:
                v = v if v is None or k not in values else v.lower() in ("1", "true", "yes", "on") if of is bool and isinstance(v, str) else of(v)
            except (TypeError, ValueError):
                errors.append(f"{at}{k} is no {of.__name__}")
                continue
            if choices and v not in choices:
                errors.append(f"{at}{k} is none of {', '.join(map(str, choices))}")
            into[k] = v

    walk(config, schema, out, "")
    if errors:
        raise ValueError("; ".join(errors))
    return out


def get_value(config: dict, dotted: str, default=None):
    for k in dotted.split("."):
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config
