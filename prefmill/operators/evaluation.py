"""Evaluation of preference scores: probabilities, losses, confusion, class reports, alerts, training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

P = ("p_a", "p_b", "p_tie")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bt_probabilities(df: DataFrame, temperature: float = 1.0, tau: float = 1.0, alpha: float = 0.5) -> DataFrame:
    d = F.least(F.lit(20.0), F.greatest(F.lit(-20.0), F.col("s_a") - F.col("s_b")))
    a = sigmoid(d / max(1e-6, temperature))
    t = F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.exp(-F.abs(d) / max(1e-6, tau)) * alpha))
    return df.withColumns({"p_a": a * (1 - t), "p_b": (1 - a) * (1 - t), "p_tie": t})


def bt_loss(df: DataFrame) -> DataFrame:
    p = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), sigmoid(F.col("s_a") - F.col("s_b"))))
    z = F.when(F.col("y_true") == 0, 1.0).when(F.col("y_true") == 1, 0.0).otherwise(0.5)
    return df.agg(F.avg(-(z * F.log(p) + (1 - z) * F.log(1 - p))).alias("loss"))


def softmax(df: DataFrame, columns=("z_a", "z_b", "z_tie")) -> DataFrame:
    top = F.greatest(*columns)
    e = [F.exp(F.col(c) - top) for c in columns]
    return df.withColumns(dict(zip(P, (x / sum(e[1:], e[0]) for x in e))))


def argmax(df: DataFrame) -> DataFrame:
    """y_pred: the first of the largest probabilities."""
    top = F.greatest(*P)
    return df.withColumn("y_pred", F.when(F.col("p_a") == top, 0).when(F.col("p_b") == top, 1).otherwise(2))


def cross_entropy(df: DataFrame, weights=(1.0, 1.0, 1.0), smoothing: float = 0.0) -> DataFrame:
    """Label-smoothed, class-weighted mean over softmax probabilities."""
    pick = lambda xs: F.when(F.col("y_true") == 0, xs[0]).when(F.col("y_true") == 1, xs[1]).otherwise(xs[2])
    nll = [-F.log(F.col(c)) for c in P]
    w = pick([F.lit(x) for x in weights])
    spread = sum((x * y for x, y in zip(nll[1:], weights[1:])), nll[0] * weights[0]) / 3
    return df.agg(((F.sum((1 - smoothing) * w * pick(nll)) + F.sum(smoothing * spread)) / F.sum(w)).alias("loss"))


def confusion(df: DataFrame, labels=(0, 1, 2)) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(x,) for x in labels], "y_true int")
    counts = df.groupBy("y_true").agg(*(F.count_if(F.col("y_pred") == x).alias(f"pred_{x}") for x in labels))
    return rows.join(counts, "y_true", "left").na.fill(0)


def class_report(df: DataFrame, labels=(0, 1, 2)) -> DataFrame:
    """precision, recall, f1 of each class; 0 where undefined."""
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("class"), ((F.col("y_true") == x) & (F.col("y_pred") == x)).cast("long").alias("tp"), (F.col("y_pred") == x).cast("long").alias("pred"), (F.col("y_true") == x).cast("long").alias("true")) for x in labels)))
    s = df.select(sides.alias("s")).select("s.*").groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "pred", "true")))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumns({"precision": zero(F.col("tp"), F.col("pred")), "recall": zero(F.col("tp"), F.col("true"))})
    return s.select("class", "precision", "recall", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def accuracy_macro_f1(df: DataFrame, labels=(0, 1, 2)) -> DataFrame:
    acc = df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return acc.crossJoin(class_report(df, labels).agg(F.avg("f1").alias("macro_f1")))


def entropy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(-sum((F.col(c) * F.log(F.col(c) + 1e-8) for c in P), F.lit(0.0))).alias("entropy"), *(F.avg(c).alias(f"mean_{c}") for c in P))


def distribution_by_class(df: DataFrame) -> DataFrame:
    return df.groupBy("y_true").agg(*(F.avg(c).alias(f"mean_{c}") for c in P), *(F.var_pop(c).alias(f"var_{c}") for c in P), F.count("*").alias("n"))


def token_budget(df: DataFrame, size: int = 32, budget: int = 387) -> DataFrame:
    """Longest and mean length, and whether the budget is reached, of each batch of rows by id."""
    longest = F.greatest("len_a", "len_b")
    return df.groupBy(F.floor(F.col("id") / size).alias("batch_id")).agg(F.max(longest).alias("len_max"), F.avg(longest).alias("len_mean"), F.max((longest >= budget).cast("int")).alias("truncated"))


def alerts(df: DataFrame) -> DataFrame:
    """Alerts of one evaluation: collapse, all_TIE, flat."""
    m = entropy(df).crossJoin(df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc")))
    even = sum(((F.abs(F.col(f"mean_{c}") - 1 / 3) <= 0.05).cast("int") for c in P), F.lit(0)) == 3
    kinds = {"collapse": even & (F.col("acc") < 0.36) & (F.col("entropy") > 0.95), "all_TIE": F.col("mean_p_tie") >= 0.95, "flat": F.col("entropy") >= 1.05}
    return m.select(F.explode(F.array(*(F.struct(F.lit(k).alias("type"), v.alias("raised")) for k, v in kinds.items()))).alias("x")).select("x.*")


def last_epoch(epochs: DataFrame) -> DataFrame:
    """The last epoch of each run in which a metric is present."""
    seen = epochs.filter("val_loss is not null or val_acc is not null or macro_f1 is not null")
    return seen.groupBy("model", "run").agg(F.max_by(F.struct("epoch", "val_loss", "val_acc", "macro_f1"), "epoch").alias("x")).select("model", "run", "x.*")


def latest_run(runs: DataFrame) -> DataFrame:
    """model, run, ts of the newest run; names are run_YYYYMMDD_HHMMSS, others are left out."""
    stamped = runs.withColumn("ts", F.try_to_timestamp(F.nullif(F.regexp_extract("run", r"^run_(\d{8}_\d{6})$", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))).filter("ts is not null")
    return stamped.groupBy("model").agg(F.max_by("run", F.struct("ts", "run")).alias("run"), F.max("ts").alias("ts"))


def latest_run_by_name(runs: DataFrame) -> DataFrame:
    """model, run: the last name of those that begin with run_, as text; names need not hold a date."""
    return runs.filter(F.col("run").startswith("run_")).groupBy("model").agg(F.max("run").alias("run"))


def leaderboard(epochs: DataFrame) -> DataFrame:
    latest = latest_run(epochs.select("model", "run").distinct()).select("model", "run")
    return last_epoch(epochs.join(latest, ["model", "run"])).select("model", "run", "macro_f1", "val_acc", "val_loss")


def early_stop(epochs: DataFrame, metric: str = "macro_f1", patience: int = 2, maximise: bool = True) -> DataFrame:
    """best so far, epochs since it, and whether training stops there, for each epoch."""
    sign = 1 if maximise else -1
    before = W.partitionBy("model", "run").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("model", "run").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    v = F.col(metric) * sign
    e = epochs.withColumn("improved", F.coalesce(v > F.coalesce(F.max(v).over(before), F.lit(float("-inf"))), F.lit(False)))
    e = e.withColumns({"best": F.max(v).over(upto) * sign, "since": F.col("epoch") - F.max(F.when(F.col("improved"), F.col("epoch"))).over(upto)})
    return e.select("model", "run", "epoch", "improved", "best", "since", (F.col("since") >= patience).alias("stop"))


def melt_confusion(wide: DataFrame) -> DataFrame:
    """true, pred, count from columns true and pred_*; what is not a number counts 0. Labels A, B, TIE come first."""
    cols = [c for c in wide.columns if c.startswith("pred_")] or [c for c in wide.columns if c.lower() != "true"]
    long = wide.select(F.col("true").cast("string"), *(F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)).cast("long").alias(c) for c in cols)).unpivot("true", cols, "pred", "count")
    rank = lambda c: F.when(F.col(c) == "A", 0).when(F.col(c) == "B", 1).when(F.col(c) == "TIE", 2).otherwise(3)
    long = long.withColumn("pred", F.regexp_replace("pred", "^pred_", ""))
    return long.withColumns({"true_rank": rank("true"), "pred_rank": rank("pred")})


def fold_metrics(epochs: DataFrame, columns=("val_loss", "val_acc", "macro_f1")) -> DataFrame:
    return epochs.unpivot(["model", "run", "epoch"], [c for c in columns if c in epochs.columns], "metric", "value")


def placeholder(df: DataFrame) -> DataFrame:
    return df.select("id", *(F.lit(0.3333).alias(f"prob_{c}") for c in ("A", "B", "TIE")), F.lit("TIE").alias("pred_label"))


def pair_vectors(df: DataFrame) -> DataFrame:
    """[a, b, |a - b|, a * b] of the vectors va and vb."""
    diff, prod = F.zip_with("va", "vb", lambda x, y: F.abs(x - y)), F.zip_with("va", "vb", lambda x, y: x * y)
    return df.withColumn("features", F.concat("va", "vb", diff, prod))


def pair_encoding(df: DataFrame, first: str = "prompt_len", second: str = "respA_len", max_first: int = 96, max_second: int = 320, tokenizer_max: int = 512) -> DataFrame:
    """Lengths of encoded pairs: each side is cut to its limit, then tokens go from the longer side (of equal ones from
    the second) until the pair with its three marks fits; enc_pad fills it up."""
    budget = min(max_first + max_second + 3, tokenizer_max)
    a, b = F.least(first, F.lit(max_first)), F.least(second, F.lit(max_second))
    over = F.greatest(F.lit(0), a + b - (budget - 3))
    uneven = F.least(over, F.abs(a - b))  # these go from the longer side, the rest in turn
    rest = over - uneven
    left_a = a - F.when(a > b, uneven).otherwise(0) - F.floor(rest / 2)
    left_b = b - F.when(b > a, uneven).otherwise(0) - F.ceil(rest / 2)
    out = df.withColumns({"enc_first": left_a.cast("int"), "enc_second": left_b.cast("int")})
    return out.withColumn("enc_pad", (budget - 3 - F.col("enc_first") - F.col("enc_second")).cast("int"))


def attach(predictions: DataFrame, rows: DataFrame, lengths=("prompt_len", "respA_len", "respB_len")) -> DataFrame:
    """Predictions with the token lengths of their rows, by id."""
    return predictions.join(rows.select("id", *lengths), "id")


def last_distribution(epochs: DataFrame, columns=("dist_A", "dist_B", "dist_TIE")) -> DataFrame:
    """The predicted class shares of each run's last epoch; runs without these columns give none."""
    if not set(columns) <= set(epochs.columns):
        return epochs.limit(0).select("model", "run")
    return epochs.groupBy("model", "run").agg(F.max_by(F.struct(*columns), "epoch").alias("x")).select("model", "run", "x.*")


def steps(rows: int, batch: int, epochs: int, accumulate: int, ratio: float) -> tuple[int, int]:
    """Total and warm-up steps."""
    total = max(1, epochs * -(-rows // batch) // accumulate)
    return total, int(ratio * total)


NAMES = ("A", "B", "TIE")
_EPOCH = ("model", "run", "epoch")


def epoch_rows(steps: DataFrame, predictions: DataFrame, by=_EPOCH) -> DataFrame:
    """A row for each epoch of a run that has steps, to 6 places: the mean loss of its steps, and of its validation rows
    the loss, accuracy and macro F1, precision, recall and F1 of each class (0 where undefined), the mean probabilities
    and the entropy. An epoch without validation has nulls there."""
    trained = steps.groupBy(*by).agg(F.avg("loss").alias("mean_train_loss"))
    hit = lambda k: F.count_if((F.col("y_true") == k) & (F.col("y_pred") == k)).alias(f"tp{k}")
    counts = [x for k in range(3) for x in (hit(k), F.count_if(F.col("y_pred") == k).alias(f"np{k}"), F.count_if(F.col("y_true") == k).alias(f"nt{k}"))]
    nll = -F.log(F.when(F.col("y_true") == 0, F.col(P[0])).when(F.col("y_true") == 1, F.col(P[1])).otherwise(F.col(P[2])))
    means = {"val_loss": nll, "val_acc": (F.col("y_true") == F.col("y_pred")).cast("double"), **{f"dist_{n}": F.col(c) for n, c in zip(NAMES, P)}, "entropy": -sum((F.col(c) * F.log(F.col(c) + 1e-8) for c in P), F.lit(0.0))}
    judged = predictions.groupBy(*by).agg(*(F.avg(v).alias(n) for n, v in means.items()), *counts)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = {}
    for k, n in enumerate(NAMES):
        tp, pred, true = (F.col(f"{c}{k}") for c in ("tp", "np", "nt"))
        per |= {f"precision_{n}": zero(tp, pred), f"recall_{n}": zero(tp, true), f"f1_{n}": zero(2 * tp, pred + true)}
    judged = judged.withColumns(per).withColumn("macro_f1", (F.col("f1_A") + F.col("f1_B") + F.col("f1_TIE")) / 3)
    order = ["mean_train_loss", "val_loss", "val_acc", "macro_f1", *per, *(f"dist_{n}" for n in NAMES), "entropy"]
    return trained.join(judged, list(by), "left").select(*by, *(F.round(c, 6).alias(c) for c in order))


def epoch_series(epochs: DataFrame, metrics=("val_acc", "macro_f1", "entropy")) -> DataFrame:
    """Points of the curves of each run; metrics that a table or a model lacks give none."""
    return fold_metrics(epochs, metrics).filter("value is not null")


def f1_by_class(df: DataFrame, by: str = "model", labels=(0, 1, 2)) -> DataFrame:
    """A row for each model, a column f1_k for each class; 0 where undefined."""
    hits = [x for k in labels for x in (F.count_if((F.col("y_true") == k) & (F.col("y_pred") == k)).alias(f"tp_{k}"), (F.count_if(F.col("y_pred") == k) + F.count_if(F.col("y_true") == k)).alias(f"n_{k}"))]
    return df.groupBy(by).agg(*hits).select(by, *(F.coalesce(F.try_divide(2.0 * F.col(f"tp_{k}"), F.col(f"n_{k}")), F.lit(0.0)).alias(f"f1_{k}") for k in labels))


#: Losses by name: probabilities in, one mean out.
LOSSES = {"cross_entropy": cross_entropy, "bradley_terry": bt_loss}


def loss(name: str):
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; there are {', '.join(LOSSES)}")
    return LOSSES[name]
