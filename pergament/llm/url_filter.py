"""URL filter: fixed rules first, then logistic regression on hashed character n-grams.

DataFrame functions and spark.ml (JVM) only. The classifier is trained from a small
labelled URL table: a caller's own, or by default ``labelled_urls``, invented URLs of
unwanted and of plain sites. The rules' verdicts are no labels: they say where a site
lies, not what it is.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Verdict, host, path prefix of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Invented words for the labelled table, by what a site is.
UNWANTED = (
    "adult", "xxx", "porn", "nude", "escort", "sexcam", "casino", "slots", "poker", "roulette", "jackpot", "bets", "betting", "lottery",
    "pills", "viagra", "pharmacy-deals", "steroids", "diet-miracle", "payday-loan", "quick-cash", "get-rich", "warez", "keygen", "torrent",
    "spam", "link-farm", "click-farm", "ads", "adserver", "tracker", "tracking", "popup", "malware", "phishing", "free-prize",
)
PLAIN = (
    "news", "weather", "recipes", "garden", "library", "museum", "school", "university", "travel", "health", "science", "history", "music", "books",
    "maps", "docs", "wiki", "forum", "football", "local", "city", "arts", "cinema", "energy", "water", "law", "market", "jobs", "family", "kitchen",
    "review", "photo", "nature", "tennis", "theatre", "opera", "letters", "journal", "times", "herald", "radio", "studio", "cycling", "hiking",
    "haus", "schule", "reise", "wetter", "maison", "jardin", "livre", "voyage", "casa", "tiempo", "libro", "mundo",
)
# What the names of such sites are put together with, before and behind the word.
LURES = (("free", "best", "hot", "cheap", "buy", "win", "mega", "super", "real", "instant", "secret", "lucky"), ("online", "deals", "bonus", "24", "365", "4you", "vip", "live", "now", "club", "shop", "zone"))
CIVIC = (("the", "city", "town", "national", "open", "royal", "our", "county", "old", "north", "saint", "public"), ("society", "institute", "council", "trust", "gallery", "archive", "press", "association", "group", "house", "centre", "today"))
BAIT = ("/bonus/", "/join", "/signup.php", "/go/834", "/out/12.html", "/promo/20/", "/click/", "/vip/page/7")
CALM = ("/about", "/archive/2020/05", "/collections/7/", "/staff.html", "/events/12", "/contact/", "/a/b/c.html", "/index.php")
SITES = ("www.", "", "blog.", "m.", "http.", "de.")
PATHS = ("/", "/en/12", "/fr/834.html", "/de/page/7/", "/es/4", "/archive/2020/05", "/index.php", "/a/b/c.html")
ENDS = ("com", "org", "net", "info", "example.org", "example.net", "example.com")
TRAIN_ROWS = 8_000
FEATURES = 1 << 16
GRAMS = (3, 4)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or # (or the end), A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict; the longest fitting rule wins, null where none fits."""
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = verdict = F.lit(None).cast("string")
    for name, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, name).otherwise(verdict)
    return parts.withColumns({"rule": rule, "rule_verdict": verdict})


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by the part they come from."""

    def of(text: Column, mark: str, n: int) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.concat(F.lit(mark), F.substring(text, at, F.lit(n))))

    return F.concat(*(of(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in GRAMS))


def labelled_urls(spark: SparkSession, unwanted=UNWANTED, plain=PLAIN, each: int = 21) -> DataFrame:
    """(url, label 1.0 = block): ``each`` invented URLs for every word.

    Of seven, one has the bare word as its site, four the word with a lure or with something
    civic before or behind it, two the word in the path of a site of such a kind. Every
    second path is one that both kinds of site have.
    """
    rows = []
    for label, words, (before, behind), own in ((1.0, unwanted, LURES, BAIT), (0.0, plain, CIVIC, CALM)):
        for k, word in enumerate(words):
            for n in range(each):
                first, last = before[(k + 5 * n) % len(before)], behind[(3 * k + 7 * n) % len(behind)]
                glue = "-" if (k + n) % 3 else ""
                name = (word, first + glue + word, word + glue + last, first + glue + word, word + glue + last, first + glue + last, first + glue + last)[n % 7]
                path = PATHS[(k + n) % len(PATHS)] if (k + n // 7) % 2 else own[(k + 3 * n) % len(own)]
                path = f"/{word}{path}" if n % 7 >= 5 else path
                rows.append((f"http://{SITES[(k + n) % len(SITES)]}{name}.{ENDS[(3 * k + n) % len(ENDS)]}{path}", label))
    return spark.createDataFrame(rows, "url string, label double")


def features(df: DataFrame) -> DataFrame:
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return hashed.transform(df.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> LogisticRegressionModel | None:
    """Fit on (host, path, label 1.0 = block); at most ``rows`` distinct ones. None if a class is missing."""
    some = labelled.groupBy("host", "path").agg(F.max("label").alias("label")).orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)
    table = features(some).cache()
    try:
        if table.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(regParam=1e-3, maxIter=60).fit(table.select("features", "label"))
    finally:
        table.unpersist()


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) of every row.

    labelled: (url, label 1.0 = block, 0.0 = allow), of which at most TRAIN_ROWS distinct
    URLs, picked by hash, are fitted on; default ``labelled_urls``. Null url or no ://: empty
    host and path, judged by the model like any other (allow where no model can be trained). Null page_ids and repeated rows stay; an empty table gives no
    rows; extra columns are ignored.
    """
    rows = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    known = labelled.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    model = train(known.select("host", "path", "label"))
    if model is None:
        scored = rows.withColumn("block_probability", F.lit(0.0))
    else:
        scored = model.transform(features(rows)).withColumn("block_probability", F.get(vector_to_array("probability"), F.lit(1)))
    by_model = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "block_probability")
