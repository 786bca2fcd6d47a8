"""URL filters: rules first, else host word segmentation and naive Bayes.

Names without separators are split into words by Viterbi decoding under a unigram model whose words
are a fixed list of English seeds and the separated parts of all hosts and paths, each counted once
for a registered domain; a part that splits into other words of the model is a joined name and no
word, however frequent. The segmented tokens of host and path are scored by multinomial naive Bayes
models of two classes. No table labels URLs; the rules do: a URL that a rule decides teaches its
verdict, and all others are judged by what was learned. Words, counts and odds are tables that are
joined; none is cut to a size or held by one process.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import materialize, read_tables, ship, task

#: Common words of names, so that joined names can be split from the start.
WORD_SEEDS = (
    "best", "blog", "book", "buy", "city", "click", "club", "cloud", "data", "day", "deal", "download", "farm", "forum",
    "free", "game", "games", "health", "home", "hot", "info", "life", "link", "live", "mail", "media", "money", "movie",
    "music", "net", "news", "now", "online", "page", "photo", "play", "sale", "school", "search", "shop", "site", "sport",
    "store", "tech", "the", "top", "travel", "video", "web", "wiki", "win", "work", "world",
)
#: (verdict, host, path prefix) of the rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Times that a seed word counts as seen at least.
MIN_SEED = 200
SMOOTHING = 1.0
#: Folds of labelled urls by a hash of host and path, and the one that agreement() holds out.
FOLDS, HELD_OUT = 4, 2
#: Characters of the longest word; a longer run is cut where it must be.
LONGEST = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for a null url or one without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_and_verdict(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path prefix, and its verdict; null if none does.

    A rule fits its host and all subdomains, if the path starts with its prefix.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # the longest is tried last, so it is outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def viterbi(name: str, cost: dict[str, float], total: int) -> tuple[str, ...]:
    """The likeliest words of name; the cost of one that has none given falls tenfold with each character."""
    if name.isdigit():
        return ("#",)
    unknown, tenfold = math.log(total), math.log(10)
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        low = None
        for start in range(max(0, end - LONGEST), end):
            w = name[start:end]
            c = best[start] + (cost[w] if w in cost else unknown + (end - start - 1) * tenfold)
            if low is None or c < low[0]:
                low = (c, start)
        best.append(low[0])
        back.append(low[1])
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return tuple(out[::-1])


class Segmenter:
    """Splits a name into the likeliest words of a unigram model that is at hand as a whole."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items() if len(w) <= LONGEST}

    def split(self, name: str) -> tuple[str, ...]:
        return viterbi(name, self.cost, self.total)


def _parts(text: Column) -> Column:
    """The lower-cased runs of letters and digits, `#` for those of digits alone."""
    runs = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(runs, lambda w: F.when(w.rlike(r"^\p{N}+$"), F.lit("#")).otherwise(w))


def _exploded(urls: DataFrame, *keys: str, others: tuple[str, ...] = ()) -> DataFrame:
    """(others, keys, pos, is_host, w): the parts of host and of path, whichever are keys."""
    named = lambda k: F.transform(_parts(F.col(k)), lambda w: F.struct(F.lit(k == "host").alias("is_host"), w.alias("w")))
    kinds = [named(k) for k in keys]
    return urls.select(*others, *keys, F.posexplode(F.concat(*kinds)).alias("pos", "part")).select(*others, *keys, "pos", "part.is_host", "part.w")


def _split(names: DataFrame, model: DataFrame, total: int, own: bool) -> DataFrame:
    """(w, tokens, known) of names(w) under model(w, n); known if all tokens are digits or in the model. Without own, a name is not a word for itself.

    A name meets only the words that it contains.
    """
    ship(names.sparkSession)
    size = F.length("w")
    contained = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - i + 1)), lambda k: F.substr(F.col("w"), i, k)))
    inner = names.select("w", F.explode(F.array_distinct(F.flatten(contained))).alias("s"))
    if not own:
        inner = inner.where("s <> w")
    found = inner.join(model.select(F.col("w").alias("s"), "n"), "s").groupBy("w").agg(F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))

    def run(batches):
        for b in batches:
            tokens, known = [], []
            for w, s, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                cost = {x: -math.log(c / total) for x, c in zip(s or (), n or ())}
                tokens.append(viterbi(w, cost, total))
                known.append(all(x in cost or x.isdigit() for x in tokens[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.string())), pa.array(known, pa.bool_())], names=["w", "tokens", "known"])

    return names.select("w").join(found, "w", "left").mapInArrow(task("urlfilter", run), "w string, tokens array<string>, known boolean")


def segment(urls: DataFrame) -> DataFrame:
    """(w, tokens) of every part of urls(host, path).

    A part counts once for each registered domain, taken as the last two labels of its host, and is
    a word unless the model without it splits it into words.
    """
    domain = F.substring_index(F.substring_index("host", ":", 1), ".", -2).alias("domain")
    seen = urls.select(domain, F.explode(F.array_distinct(F.concat(_parts(F.col("host")), _parts(F.col("path"))))).alias("w")).distinct()
    parts = materialize(seen.groupBy("w").agg(F.count("*").alias("n")), "url-parts")
    counts = parts.where("w <> '#'")
    seeds = WORD_SEEDS
    seen_in_all = counts.agg(F.sum("n")).first()[0] or 0
    weight = max(MIN_SEED, seen_in_all // len(seeds))  # the seeds weigh as much as all that is seen
    sown = urls.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, seeds))).alias("w"), F.lit(weight).cast("long").alias("n"))
    total = seen_in_all + weight * len(seeds) + 1
    model = materialize(counts.unionByName(sown).groupBy("w").agg(F.sum("n").alias("n")).where(F.length("w") <= LONGEST), "url-words")
    joined = _split(counts.where(~F.col("w").isin(*seeds)), model, total, own=False).where("known and size(tokens) > 1")
    words = materialize(model.join(joined.select("w"), "w", "left_anti"), "url-words")
    return materialize(_split(parts, words, total, own=True).select("w", "tokens"), "url-splits")


def learn(labelled: DataFrame, splits: DataFrame) -> DataFrame:
    """(is_host, t, odds): log-odds of `block` for the tokens of distinct labelled(host, path, bad), both classes being as likely beforehand.

    Host tokens are counted by hosts in each class, path tokens by urls, each kind normalised for
    itself. Smoothing is towards the share of both classes, so a token of which nothing is known in
    a class, or a class without urls, says nothing.
    """
    hosts = _exploded(labelled.select("host", "bad").distinct(), "host", others=("bad",)).join(splits, "w").groupBy("host", "bad").agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("ts"))
    paths = _exploded(labelled, "path", others=("host", "bad")).join(splits, "w").groupBy("host", "path", "bad").agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("ts"))
    tokens = hosts.select(F.lit(True).alias("is_host"), "bad", F.explode("ts").alias("t")).unionByName(paths.select(F.lit(False).alias("is_host"), "bad", F.explode("ts").alias("t")))
    counts = materialize(tokens.groupBy("is_host", "t").agg(F.count_if(~F.col("bad")).alias("a"), F.count_if("bad").alias("b")), "url-counts")
    odds = F.lit(0.0)
    for r in counts.groupBy("is_host").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("size")).collect():  # hosts and paths: two rows
        mass = SMOOTHING * r["size"]
        prior = mass * (F.col("a") + F.col("b")) / (r["a"] + r["b"])
        of_kind = F.log((F.col("b") + prior) / (r["b"] + mass)) - F.log((F.col("a") + prior) / (r["a"] + mass))
        odds = F.when(F.col("is_host") == r["is_host"], of_kind).otherwise(odds)
    return materialize(counts.select("is_host", "t", odds.alias("odds")), "url-odds")


def _total() -> Column:
    """Sum of odds in the order of pos, so that it has the same last digits in every run."""
    return F.aggregate(F.sort_array(F.collect_list(F.struct("pos", "odds"))), F.lit(0.0), lambda s, x: s + x["odds"]).alias("odds")


def scores(urls: DataFrame, rules: Iterable[tuple[str, str, str]], learned: Column | None = None) -> DataFrame:
    """(host, path, odds) of distinct urls(host, path) that have any part; learned limits the urls that teach."""
    splits = segment(urls)
    _, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    labelled = urls.where(verdict.isNotNull() if learned is None else verdict.isNotNull() & learned)
    odds = learn(labelled.select("host", "path", (verdict == "block").alias("bad")), splits)
    tokens = splits.select("w", F.posexplode("tokens").alias("pos", "t")).withColumn("is_host", F.explode(F.array(F.lit(True), F.lit(False))))
    parts = tokens.join(odds, ["is_host", "t"], "left").fillna(0.0, ["odds"]).groupBy("is_host", "w").agg(_total())
    parts = materialize(parts, "url-part-odds")
    return _exploded(urls, "host", "path").join(parts, ["is_host", "w"]).groupBy("host", "path").agg(_total())


def _urls(pages: DataFrame, url_col: str, *others) -> DataFrame:
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    return pages.select(*others, host.alias("host"), path.alias("path"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, block_odds) of every row.

    A row that a rule fits has the rule's verdict; any other has the model's: block if the log-odds
    are positive. A null url, or one without `://`, has an empty host and path, which no rule fits
    and no token speaks against, so they are allowed; so is every row without a rule if none teaches
    `block`. Repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    urls = _urls(pages, url_col, F.col(f"`{id_col}`").alias("id"))
    known = materialize(scores(materialize(urls.select("host", "path").distinct(), "url-distinct"), rules), "url-scores")
    name, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    odds = F.coalesce("odds", F.lit(0.0))
    said = F.coalesce(verdict, F.when(odds > 0, "block").otherwise("allow"))
    return urls.join(known, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), said.alias("verdict"), odds.alias("block_odds"))


def agreement(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """(label, n, agreed): how many distinct urls that a rule decides the model judges alike if they teach nothing.

    One fold in FOLDS, by a hash of host and path, is held out.
    """
    urls = materialize(_urls(pages, url_col).distinct(), "url-distinct")
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == HELD_OUT
    _, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    known = scores(urls, rules, ~fold)
    held = urls.where(fold & verdict.isNotNull()).select("host", "path", verdict.alias("label")).join(known, ["host", "path"], "left")
    alike = (F.coalesce("odds", F.lit(0.0)) > 0) == (F.col("label") == "block")
    return held.groupBy("label").agg(F.count("*").alias("n"), F.count_if(alike).alias("agreed"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    (pages,) = read_tables(spark, sf_dir, "pages")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_odds")
