"""URL filters: rules for hosts and paths, and logistic regression for all other urls (op 11). DataFrame functions only.

Host: what follows the first :// up to /, ?, # or the end, A-Z lower-cased; path: what follows up to ?, # or the end. A
null url, or one without ://, has neither. A rule (host, path, verdict) fits its host and all subdomains, if the path
starts with the rule's path; of those that fit the longest wins, of equally long ones the first in order of text.

The model: the distinct character n-grams (3 and 4 code points) of ^host$ and of the path, each with its kind, are
hashed into BUCKETS; every bucket that occurs weighs 1 / sqrt(their number). Logistic regression with an intercept is
fitted by ROUNDS of full gradient descent with momentum, over at most LABELLED rows of a table of labelled
urls: the rows and their postings make one array each, and a round is one expression over them. The model is
one row, which meets the urls as a scalar subquery. There is no shuffle of the urls and no Python worker.

Cases: an empty host and path have no n-grams and get the intercept's verdict; labelled rows without url or label don't
count; no labelled rows give weights of 0 and allow throughout; repeated rows stay; other columns are not carried on.
"""

from __future__ import annotations

from itertools import cycle, product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import let
from . import common

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SIZES = (3, 4)
BUCKETS = 1 << 12
ROUNDS, RATE, MOMENTUM = 100, 4.0, 0.9
#: Labelled urls that the model is fitted on, at most, in order of a hash.
LABELLED = 4_000
#: Probability of block above which the model blocks.
BLOCK_AT = 0.5
#: Rules up to which the verdict is one expression; longer lists are joined.
INLINE = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the labelled table. Gambling, medicine and adult spam, advertising, bulk mail, loans, copies.
BLOCKED = "casino poker bets betting slots jackpot roulette pills pharmacy viagra tablets adult porn xxx escort cams ads adserver track tracker popup banner clicks spam mailer warez keygen loans payday replica cheap win bonus free-gift".split()
ALLOWED = "news library university museum garden weather recipes science travel history music school city hospital journal archive gallery theatre village council forest river bridge railway kitchen bakery letters poetry physics chemistry geology botany language grammar atlas maps photo sports football cycling chess theory lecture notes manual docs wiki forum blog review magazine report gazette".split()
_FRONTS = ("", "www.", "m.", "blog.", "shop.", "en.")
_ENDS = ("com", "net", "org", "info", "co.uk", "de")
_PATHS = ("/en/{n}", "/de/{n}.html", "/{n}/", "/fr/{n}", "", "/", "/index.html", "/es/{n}", "/articles/{n}", "/page/{n}")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block): both lists of words alone and in pairs, with the same fronts, ends and paths dealt round."""

    def made(words: list[str], own: tuple[str, ...]):
        front, end, path = cycle(_FRONTS), cycle(_ENDS[:5]), cycle(_PATHS + own)
        pairs = [(a, words[(k * 7 + s) % len(words)], j) for k, a in enumerate(words) for s, j in product((1, 3, 8, 14), ("-", ""))]
        names = [*words, *words, *(a + j + b for a, b, j in pairs if a != b)]
        return [f"https://{next(front)}{name}.{next(end)}{next(path).format(n=k * 37 % 9973)}" for k, name in enumerate(names)]

    urls = [(u, y) for y, words, own in ((1, BLOCKED, ("/buy-{n}", "/offer/{n}")), (0, ALLOWED, ("/about", "/docs/{n}"))) for u in made(words, own)]
    rows = ",".join(f"('{u}', {y})" for u, y in urls)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column) -> Column:
    """The distinct buckets of a url's n-grams, ascending."""

    def of(kind: str, chars: Column, n: int) -> Column:
        gram = lambda i: F.pmod(F.xxhash64(F.concat(F.lit(kind), *[F.get(chars, i + j) for j in range(n)])), F.lit(BUCKETS)).cast("int")
        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), gram)).otherwise(F.array().cast("array<int>"))

    chars = lambda text: F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    marked = F.when(host != "", F.concat(F.lit("^"), host, F.lit("$"))).otherwise("")
    grams = lambda kind, text: let(chars(text), lambda c: F.concat(*[of(kind, c, n) for n in SIZES]))
    return F.sort_array(F.array_distinct(F.concat(grams("h", marked), grams("p", path))))


def train(spark: SparkSession, labelled: DataFrame, rounds: int = ROUNDS, rate: float = RATE, most: int = LABELLED) -> DataFrame:
    """The model, stored: one row of weights (a double for each bucket) and the intercept."""
    host, path = host_path(F.col("url"))
    rows = labelled.select("url", F.col("label").cast("int").alias("y")).filter("url is not null and y in (0, 1)")
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(most).select("url", "y", buckets(host, path).alias("at"))
    each = F.struct(F.xxhash64("url").alias("h"), "url", "y", (1 / F.sqrt(F.greatest(F.size("at"), F.lit(1)))).alias("x"), "at")
    one = common.materialise(spark, rows.groupBy().agg(F.transform(F.sort_array(F.collect_list(each)), lambda e: e.dropFields("h", "url")).alias("rows")), "op11-rows")
    told = one.select(F.posexplode("rows").alias("row", "e")).select("row", "e.x", F.explode("e.at").alias("bucket"))
    told = told.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("row", "x"))).alias("told"))
    none = F.array().cast("array<struct<row:int,x:double>>")
    lists = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(told, "bucket", "left").select("bucket", F.coalesce("told", none).alias("told"))
    lists = lists.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "told"))), lambda s: s["told"]).alias("lists"))
    zero = F.lit(0.0)
    zeros = F.array_repeat(zero, BUCKETS).cast("array<double>")
    start = F.struct(zeros.alias("w"), zero.alias("b"), zeros.alias("v"), zero.alias("vb"))
    n = F.greatest(F.size("rows"), F.lit(1))

    def step(a: Column, _: Column) -> Column:
        off = F.transform("rows", lambda r: (1 / (1 + F.exp(-margin(a["w"], a["b"], r["at"], r["x"]))) - r["y"]) / n)
        slope = lambda d, told: F.aggregate(told, zero, lambda s, t: s + F.get(d, t["row"]) * t["x"])
        speed = lambda d: F.struct(F.transform("lists", lambda told, k: MOMENTUM * F.get(a["v"], k) - rate * slope(d, told)).alias("v"), (MOMENTUM * a["vb"] - rate * F.aggregate(d, zero, lambda s, x: s + x)).alias("vb"))
        return let(let(off, speed), lambda m: F.struct(F.zip_with(a["w"], m["v"], lambda x, y: x + y).alias("w"), (a["b"] + m["vb"]).alias("b"), m["v"].alias("v"), m["vb"].alias("vb")))

    # two single rows
    model = one.join(lists).select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m"))
    return common.materialise(spark, model.select("m.w", "m.b"), "op11-model")


def margin(w: Column, b: Column, at: Column, x: Column) -> Column:
    return b + x * F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(w, i))


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (with host, path) and for each the longest rule that fits, or null: its text (host and path) and verdict. A
    list is one expression. A table is joined by its text: of a url's host the last domains, as many as the longest
    rule has, meet the beginnings of its path in the lengths that the rules have."""
    if not isinstance(rules, DataFrame):
        if len(rules) > INLINE:
            raise ValueError(f"more than {INLINE} rules: pass a DataFrame of host, path, verdict")
        fits = lambda h, p: F.concat(F.lit("."), F.col("host")).endswith("." + h) & F.col("path").startswith(p)
        ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
        found = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("of_rule"))) for h, p, v in ordered]
        return urls.withColumn("found", F.coalesce(*found, F.lit(None).cast("struct<rule:string,of_rule:string>"))).select(*urls.columns, "found.rule", "found.of_rule")
    table = rules.filter("host is not null and path is not null and verdict is not null").groupBy(F.concat("host", "path").alias("rule")).agg(F.min("verdict").alias("of_rule"))
    sizes = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("deep"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    parts = F.split("host", r"\.")
    ends = lambda p: F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(sizes["deep"] or 1))), lambda k: F.array_join(F.slice(p, -k, k), "."))
    begins = F.array(*[F.left(F.col("path"), F.lit(k)) for k in sizes["lengths"] or [0]])
    keys = let(begins, lambda b: F.array_distinct(F.flatten(F.transform(let(parts, ends), lambda e: F.transform(b, lambda x: F.concat(e, x))))))
    each = urls.withColumn("row", F.monotonically_increasing_id()).withColumn("rule", F.explode(keys)).join(table, "rule", "left")
    best = F.max(F.when(F.col("of_rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "of_rule"))).alias("best")
    return each.groupBy("row").agg(*[F.first(c).alias(c) for c in urls.columns], best).select(*urls.columns, "best.rule", "best.of_rule")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, model: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule (or null), verdict (the rule's, else the model's), score (the model's probability
    of block)."""
    host, path = host_path(F.col("url").cast("string"))
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    told = ruled(urls, rules).withColumns({"at": buckets(F.col("host"), F.col("path")), "w": model.select("w").scalar(), "b": model.select("b").scalar()})
    x = 1 / F.sqrt(F.greatest(F.size("at"), F.lit(1)))
    scored = told.withColumn("score", 1 / (1 + F.exp(-margin(F.col("w"), F.col("b"), F.col("at"), x))))
    own = F.when(F.col("score") > BLOCK_AT, "block").otherwise("allow")
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("of_rule", own).alias("verdict"), "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark, labelled_urls(spark))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, model).drop("url")
