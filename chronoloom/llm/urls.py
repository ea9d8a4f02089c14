"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import ascii_lower

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# What the labelled URL table is made of: first and second words of hosts, and words of paths, of unwanted and of wanted sites.
UNWANTED = (
    """casino poker slots jackpot lottery bet bingo roulette pills pharma viagra cialis adult xxx cams escort hookup payday loan cash
    replica warez crack torrent keygen spam click popup prize diet forex""".split(),
    """bonus cheap win free deals 4u online-24 hot club buy spins vip promo offers now best""".split(),
    """free-spins win-now bonus-code cheap-pills buy-now no-deposit live-cams hot-singles quick-cash instant-loan serial-key full-crack
    affiliate promo-offer best-odds lose-weight""".split(),
)
WANTED = (
    """library museum school college garden weather history science kitchen travel research music theatre nature council archive journal
    news health chess book physics chemistry railway language gallery harbour mountain river forest village bakery observatory
    cooking painting hiking writing farming sailing engineering evening northern southern mathematics theology author church city county
    ministry""".split(),
    """society times press house studies review guide notes forum centre trust report academy workshop group world""".split(),
    """about opening-hours annual-report article contact events lecture-notes recipe local-news staff members index publications
    exhibition timetable documentation""".split(),
)
NGRAMS = (2, 3, 4)
LOG2_FEATURES = 16
MOST_ORDINARY = 2000  # hosts of the pages themselves that the model learns as ordinary ones


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(host), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and verdict; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. `rules` is a list a person keeps, part of
    the plan; of equal lengths the first in the list wins.
    """
    text = verdict = F
    for action, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = text.when(fits, rule_host + rule_path)
        verdict = verdict.when(fits, action)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if text is F else (text, verdict)


def ngrams(text: Column, tag: str, sizes=NGRAMS) -> Column:
    """Character n-grams of a text with a mark at both ends, prefixed by `tag`; time is linear in the text."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def grams(n: int) -> Column:
        joined = reduce(lambda a, k: F.zip_with(a, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda x, y: F.concat(x, y)), range(1, n), chars)
        return F.transform(F.filter(joined, lambda g: g.isNotNull()), lambda g: F.concat(F.lit(f"{tag}{n}:"), g))

    return F.concat(*[grams(n) for n in sizes])


def featured(urls: DataFrame) -> DataFrame:
    """Adds host, path and _grams to a table with `url`. Paths lose their digits, which number pages."""
    host, path = url_parts(F.col("url"))
    named = urls.withColumns({"host": host, "path": path})
    plain = F.regexp_replace("path", "[0-9]+", "0")
    return named.withColumn("_grams", F.array_distinct(F.concat(ngrams(F.col("host"), "h"), ngrams(plain, "p"))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A labelled table (url, label: 1 unwanted, site: its host's two words), built from the word lists by rule.

    Each first word meets each second one once. Ends of hosts, language folders, numbers and suffixes turn in both kinds alike, so
    they say nothing; every other URL has a word in its path. There are more wanted sites, as on the web.
    """
    fronts, tops = ("", "www.", "blog.", "m."), ("com", "net", "org", "example.com", "example.net", "example.org")
    langs, ends = ("en", "de", "fr", "es"), ("", "/", ".html", "?ref=x", "#top")
    rows = []
    for label, (firsts, seconds, folders) in ((1.0, UNWANTED), (0.0, WANTED)):
        for i, first in enumerate(firsts):
            for j, second in enumerate(seconds):
                k = i * len(seconds) + j
                pair = (first, second) if k % 3 else (second, first)
                site = ("-" if k % 2 else "").join(pair)
                folder = f"/{folders[(3 * i + j) % len(folders)]}" if k % 2 else ""
                rows.append((f"https://{fronts[(i + j) % 4]}{site}.{tops[k % 6]}/{langs[(i + 2 * j) % 4]}{folder}/{100 + k}{ends[k % 5]}", label, f"{first} {second}"))
    return spark.createDataFrame(rows, "url string, label double, site string")


def named_unwanted(host: Column) -> Column:
    """Whether a part of a host, between dots and hyphens, is a word of unwanted sites."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for kind in UNWANTED[:2] for w in kind]))


def ordinary_urls(pages: DataFrame, most: int = MOST_ORDINARY) -> DataFrame:
    """A bounded sample (url, label 0, site: its host) of what hosts look like where the pages come from.

    Hosts that a word of the lists names are left out; of the others, the `most` of least hash give one URL each, the least. Few of
    a crawl's hosts are unwanted, so a host that no list names is taken as ordinary: without this a name like nothing in the lists
    would be judged by chance. Which rows repeat, and their order, makes no difference. An empty table gives an empty sample.
    """
    host, _ = url_parts(F.col("url"))
    one = pages.select("url", host.alias("site")).where("site <> ''").where(~named_unwanted(F.col("site"))).groupBy("site").agg(F.min("url").alias("url"))
    return one.orderBy(F.xxhash64("site"), "site").limit(most).select("url", F.lit(0.0).alias("label"), "site")


def train(labelled: DataFrame, log2_features: int = LOG2_FEATURES) -> PipelineModel:
    """Fits hashed n-grams and a logistic regression on a labelled table (url, label 0 or 1)."""
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=2**log2_features, binary=True)
    logistic = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted", regParam=0.003, maxIter=60, standardization=False)
    known = hashing.transform(featured(labelled)).coalesce(1).cache()  # a small table
    try:
        return PipelineModel([hashing, logistic.fit(known)])
    finally:
        known.unpersist()


def judge(pages: DataFrame, model: PipelineModel | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of `pages` (page_id, url).

    The model is trained on the labelled table and on ordinary_urls, if none is given. The verdict is the rule's if one fits; else block where the model's probability of an unwanted site is at least 0.5. A
    null URL or one without `://` has empty host and path, fits no rule and goes to the model like any other. Rows that repeat
    are judged each; other columns are not read.
    """
    model = model or train(labelled_urls(pages.sparkSession).union(ordinary_urls(pages)))
    scored = model.transform(featured(pages.select("page_id", "url")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    score = F.get(vector_to_array("_probability"), 1)
    by_model = F.when(score >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), score.alias("score"))
