"""Training reports over steps and validation rows that are derived from the events table.

An event is a training step (its value is the loss) or a validation row (scores and class by arithmetic on its ids). Its
model is one of three, its run the ten days it falls into, its epoch two of these days; model m3's last epoch has no
validation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation as ev, profile as pr
from ..sources import fixtures as fx

Q: dict = {}
SQL: dict = {}
METRICS = ("mean_train_loss", "val_loss", "val_acc", "macro_f1")


def q(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def _events(s: SparkSession, d: str) -> DataFrame:
    e = fx.read(s, d, "events").withColumn("day", F.dayofmonth("ts") - 1)
    m = (F.col("user_id") % 3 + 1).cast("string")
    begin = F.lpad((F.floor(F.col("day") / 10) * 10 + 1).cast("string"), 2, "0")
    run = F.concat(F.lit("run_"), F.date_format("ts", "yyyyMM"), begin, F.lit("_12000"), m)
    return e.withColumns({"model": F.concat(F.lit("m"), m), "run": run, "epoch": (F.floor(F.col("day") % 10 / 2) + 1).cast("int")})


def steps(s: SparkSession, d: str) -> DataFrame:
    """model, run, epoch, step, loss."""
    rows = _events(s, d).filter("event_type in ('view', 'click', 'signup')")
    return rows.select("model", "run", "epoch", F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss"))


def validation(s: SparkSession, d: str) -> DataFrame:
    """model, run, epoch, id, y_true, the probabilities and y_pred."""
    rows = _events(s, d).filter("event_type in ('purchase', 'error') and not (model = 'm3' and epoch = 5)")
    k = F.col("event_id")
    scores = {"z_a": k % 7 / 3.0, "z_b": k % 5 / 2.0, "z_tie": k % 3 / 1.0}
    rows = rows.select("model", "run", "epoch", k.alias("id"), ((k + F.col("user_id")) % 3).cast("int").alias("y_true"), *(v.alias(c) for c, v in scores.items()))
    return ev.argmax(ev.softmax(rows))


def epochs(s: SparkSession, d: str) -> DataFrame:
    return ev.epoch_rows(steps(s, d), validation(s, d))


_PRED = """ev0 AS (SELECT *, CAST(extract(day FROM ts) AS INT) - 1 AS day, CAST(user_id % 3 + 1 AS VARCHAR) AS m FROM events),
evs AS (SELECT *, 'm' || m AS model, 'run_' || strftime(ts, '%Y%m') || lpad(CAST(day // 10 * 10 + 1 AS VARCHAR), 2, '0') || '_12000' || m AS run, CAST(day % 10 // 2 + 1 AS INT) AS epoch FROM ev0),
vz AS (SELECT model, run, epoch, event_id AS id, CAST((event_id + user_id) % 3 AS INT) AS y_true, event_id % 7 / 3.0 AS za, event_id % 5 / 2.0 AS zb, event_id % 3 / 1.0 AS zt FROM evs WHERE event_type IN ('purchase', 'error') AND NOT (model = 'm3' AND epoch = 5)),
vs AS (SELECT *, exp(za - greatest(za, zb, zt)) AS ea, exp(zb - greatest(za, zb, zt)) AS eb, exp(zt - greatest(za, zb, zt)) AS et FROM vz),
vp AS (SELECT model, run, epoch, id, y_true, ea / (ea + eb + et) AS p_a, eb / (ea + eb + et) AS p_b, et / (ea + eb + et) AS p_tie FROM vs),
pred AS (SELECT *, CASE WHEN p_a >= p_b AND p_a >= p_tie THEN 0 WHEN p_b >= p_tie THEN 1 ELSE 2 END AS y_pred FROM vp)"""
_CLASSES = ("A", "B", "TIE")
_per = ", ".join(f"round(coalesce(tp{k} / nullif(np{k}, 0), 0.0), 6) AS \"precision_{c}\", round(coalesce(tp{k} / nullif(nt{k}, 0), 0.0), 6) AS \"recall_{c}\", round(coalesce(2 * tp{k} / nullif(np{k} + nt{k}, 0), 0.0), 6) AS \"f1_{c}\"" for k, c in enumerate(_CLASSES))
_counts = ", ".join(f"count(*) FILTER (y_true = {k} AND y_pred = {k})::DOUBLE AS tp{k}, count(*) FILTER (y_pred = {k}) AS np{k}, count(*) FILTER (y_true = {k}) AS nt{k}" for k in range(3))
_macro = " + ".join(f"coalesce(2 * tp{k} / nullif(np{k} + nt{k}, 0), 0.0)" for k in range(3))
EPOCHS = f"""{_PRED},
tr AS (SELECT model, run, epoch, round(avg(value / 100), 6) AS mean_train_loss FROM evs WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL),
v0 AS (SELECT model, run, epoch, avg(-ln(CASE y_true WHEN 0 THEN p_a WHEN 1 THEN p_b ELSE p_tie END)) AS loss, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc, {_counts}, avg(p_a) AS da, avg(p_b) AS db, avg(p_tie) AS dt, avg(-(p_a * ln(p_a + 1e-8) + p_b * ln(p_b + 1e-8) + p_tie * ln(p_tie + 1e-8))) AS h FROM pred GROUP BY ALL),
va AS (SELECT model, run, epoch, round(loss, 6) AS val_loss, round(acc, 6) AS val_acc, round(({_macro}) / 3, 6) AS macro_f1, {_per}, round(da, 6) AS "dist_A", round(db, 6) AS "dist_B", round(dt, 6) AS "dist_TIE", round(h, 6) AS entropy FROM v0),
epochs AS (SELECT * FROM tr LEFT JOIN va USING (model, run, epoch))"""
_LAST = "la AS (SELECT *, row_number() OVER (PARTITION BY model, run ORDER BY epoch DESC) AS r FROM epochs WHERE val_loss IS NOT NULL OR val_acc IS NOT NULL OR macro_f1 IS NOT NULL)"


@q("epoch_rollup", f"WITH {EPOCHS} SELECT * FROM epochs")
def epoch_rollup(s: SparkSession, d: str) -> DataFrame:
    return epochs(s, d)


@q("epoch_series", f"WITH {EPOCHS}, u AS (" + " UNION ALL ".join(f"SELECT model, run, epoch, '{c}' AS metric, {c} AS value FROM epochs" for c in ("val_acc", "macro_f1", "entropy")) + ") SELECT * FROM u WHERE value IS NOT NULL")
def epoch_series(s: SparkSession, d: str) -> DataFrame:
    return ev.epoch_series(epochs(s, d))


@q("latest_run", f"WITH {EPOCHS} SELECT model, max(run) AS run, max(strptime(substr(run, 5), '%Y%m%d_%H%M%S')) AS ts FROM epochs GROUP BY model")
def latest_run(s: SparkSession, d: str) -> DataFrame:
    return ev.latest_run(steps(s, d).select("model", "run").distinct())


@q("latest_run_by_name", f"WITH {_PRED} SELECT model, max(run) AS run FROM evs GROUP BY model")
def latest_run_by_name(s: SparkSession, d: str) -> DataFrame:
    return ev.latest_run_by_name(_events(s, d).select("model", "run").distinct())


@q("last_epoch_pick", f"WITH {EPOCHS}, {_LAST} SELECT model, run, epoch, val_loss, val_acc, macro_f1 FROM la WHERE r = 1")
def last_epoch_pick(s: SparkSession, d: str) -> DataFrame:
    return ev.last_epoch(epochs(s, d))


@q("leaderboard", f"WITH {EPOCHS}, {_LAST} SELECT model, run, macro_f1, val_acc, val_loss FROM la WHERE r = 1 AND run IN (SELECT max(run) FROM epochs e WHERE e.model = la.model)")
def leaderboard(s: SparkSession, d: str) -> DataFrame:
    return ev.leaderboard(epochs(s, d))


@q("early_stop_trace", f"""
WITH {EPOCHS}, i AS (SELECT *, coalesce(macro_f1 > coalesce(max(macro_f1) OVER (PARTITION BY model, run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9), false) AS improved, max(macro_f1) OVER (PARTITION BY model, run ORDER BY epoch) AS best FROM epochs),
n AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY model, run ORDER BY epoch) AS since FROM i)
SELECT model, run, epoch, improved, best, since, since >= 2 AS stop FROM n""")
def early_stop_trace(s: SparkSession, d: str) -> DataFrame:
    return ev.early_stop(epochs(s, d))


@q("fold_metrics", f"WITH {EPOCHS} " + " UNION ALL ".join(f"SELECT model, run, epoch, '{m}' AS metric, {m} AS value FROM epochs" for m in ("val_loss", "val_acc", "macro_f1")))
def fold_metrics(s: SparkSession, d: str) -> DataFrame:
    return ev.fold_metrics(epochs(s, d))


@q("min_max_norm", f"WITH {EPOCHS} SELECT model, run, epoch, (val_loss - min(val_loss) OVER w) / greatest(1e-9, max(val_loss) OVER w - min(val_loss) OVER w) AS norm FROM epochs WINDOW w AS (PARTITION BY model)")
def min_max_norm(s: SparkSession, d: str) -> DataFrame:
    return pr.min_max(epochs(s, d), "val_loss", "model").select("model", "run", "epoch", "norm")


@q("f1_pivot", f"WITH {EPOCHS} SELECT model, max(macro_f1) FILTER (epoch = 1) AS \"1\", max(macro_f1) FILTER (epoch = 2) AS \"2\" FROM epochs GROUP BY model")
def f1_pivot(s: SparkSession, d: str) -> DataFrame:
    return epochs(s, d).groupBy("model").pivot("epoch", [1, 2]).agg(F.max("macro_f1"))


@q("last_epoch_distribution", f"WITH {EPOCHS}, {_LAST} SELECT model, run, \"dist_A\", \"dist_B\", \"dist_TIE\" FROM la WHERE r = 1")
def last_epoch_distribution(s: SparkSession, d: str) -> DataFrame:
    return ev.last_distribution(epochs(s, d).filter("val_loss is not null"))
