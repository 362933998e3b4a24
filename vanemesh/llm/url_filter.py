"""URL filters: a list of host and path rules, and association rules mined from labelled URLs for what the list does not judge.

A listed rule fits its host and all subdomains where the URL's path starts with the rule's; of those that fit the longest (host and
path together) wins, of equal ones the first in order of the text, block before allow. The list is an inverted index from host to
rules, a literal that each URL's host suffixes look up.

Association rules: a labelled URL is a transaction of its tokens (host suffixes, leading label, path segments with digits as #, file
ending, names and values of the query, fragment) and of its label. Spark's FP-growth finds the frequent combinations; rules whose
consequent is a label, with the least confidence and support, are kept, and those that a more general rule with at least the same
confidence covers go. An inverted index from token to rules finds the rules all of whose tokens a URL has; the most confident one
decides (then support, then length, then text). URLs that no rule fits are allowed.

Bounds of learning: SAMPLE transactions, chosen by hash, and MOST tokens in each (those whose share of blocked URLs is farthest from
the overall one, of those that occur in SUPPORT of the transactions). So there are at most 2**MOST / SUPPORT frequent combinations,
a bound of what is broadcast. Judging covers every URL.

Null URLs and those without ``://`` have an empty host and path and no tokens: no rule fits, and they are allowed. Repeated rows are
judged alike. With no label, or an empty table, nothing is mined. ``judge`` keeps all columns, but for those named like its own (host,
path, rule, mined, verdict), which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import settle
from .text import fold_case, fresh

SAMPLE = 500_000
MOST = 10
SUPPORT, CONFIDENCE = 0.005, 0.6
LEAST_ROWS = 5
ALLOW, BLOCK = "allow", "block"
LABEL = "label="


@dataclass(frozen=True)
class Rule:
    """``host`` without and ``path`` with its leading slash."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next slash, question mark or hash, A-Z lowered; empty without ``://``."""
    return F.coalesce(fold_case(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next question mark or hash."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the domains above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def listed(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that wins, a struct of length, rule and verdict; null if none fits."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(rule.host, []).append(rule)
    none = F.array().cast("array<struct<length:int,path:string,rule:string,verdict:string>>")
    if not index:
        return F.get(none, 0)

    def entry(rule: Rule) -> Column:
        return F.struct(F.lit(-len(rule.text)).alias("length"), F.lit(rule.path).alias("path"), F.lit(rule.text).alias("rule"),
                        F.lit({BLOCK: "0", ALLOW: "1"}[rule.verdict] + rule.verdict).alias("verdict"))

    rules_of = F.create_map(*[x for h, own in index.items() for x in (F.lit(h), F.array(*map(entry, own)))])
    near = F.flatten(F.transform(suffixes(host), lambda s: F.coalesce(F.element_at(rules_of, s), none)))
    fitting = F.filter(near, lambda r: F.startswith(path, r["path"]))
    return F.array_min(F.transform(fitting, lambda r: F.struct(r["length"], r["rule"], r["verdict"])))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, array<string>; none without ``://``."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)/?$", 1)
    found = F.concat(
        F.transform(suffixes(host), lambda s: F.concat(F.lit("host="), s)),
        F.array(F.concat(F.lit("first="), F.substring_index(host, ".", 1))),
        F.transform(segments, lambda s: F.concat(F.lit("path="), s)),
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("query="), q)),
        F.transform(F.filter(F.split(query, "&"), lambda q: F.contains(q, F.lit("="))), lambda q: F.concat(F.lit("name="), F.substring_index(q, "=", 1))),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def transactions(labelled: DataFrame, support: float = SUPPORT, most: int = MOST, sample: int = SAMPLE) -> DataFrame:
    """A written table, items: at most ``most`` tokens of about ``sample`` rows at most of ``labelled`` (url, label), and the label."""
    known = labelled.where(F.col("label").isin(ALLOW, BLOCK) & F.col("url").isNotNull()).select("url", "label")
    share = min(1.0, sample / max(known.count(), 1))
    hashed = (F.xxhash64("url", F.lit(1)).bitwiseAND(F.lit(2**62 - 1)) / F.lit(float(2**62))) if share < 1 else F.lit(0.0)
    rows = settle(known.where(hashed < share).select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), "label"), "urls")
    n, base = rows.agg(F.count(F.lit(1)), F.avg((F.col("label") == BLOCK).cast("int"))).first()
    each = rows.select("row", "label", F.explode("tokens").alias("token"))
    stats = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == BLOCK).cast("int")).alias("share"))
    # At most as many tokens of a transaction as it has tokens, each in support * n transactions: longest / support rows.
    useful = settle(stats.where(F.col("n") >= max(LEAST_ROWS, support * n)).select("token", F.abs(F.col("share") - F.lit(base or 0.0)).alias("lift")), "tokens")
    # Tokens by row: sums before the shuffle cannot help here, but the sample bounds the rows.
    chosen = each.join(useful, "token").groupBy("row", "label").agg(F.sort_array(F.collect_list(F.struct((-F.col("lift")).alias("lift"), "token"))).alias("x"))
    return settle(chosen.select(F.array_append(F.transform(F.slice("x", 1, most), lambda t: t["token"]), F.concat(F.lit(LABEL), "label")).alias("items")), "transactions")


@dataclass
class Mined:
    """Association rules and their inverted index: token to the rules that have it."""

    rules: list[tuple[tuple[str, ...], str, float, float]]
    index: dict[str, list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.rules = sorted(self.rules, key=lambda r: (-r[2], -r[3], -len(r[0]), r[0], r[1]))
        self.index = {}
        for i, (tokens_, *_) in enumerate(self.rules):
            for t in tokens_:
                self.index.setdefault(t, []).append(i)

    def best(self, tokens_: list[str]) -> int | None:
        """The first rule in order all of whose tokens are there."""
        hits: dict[int, int] = {}
        for t in tokens_:
            for i in self.index.get(t, ()):
                hits[i] = hits.get(i, 0) + 1
        return min((i for i, n in hits.items() if n == len(self.rules[i][0])), default=None)


def general(rules: list[tuple[tuple[str, ...], str, float, float]]) -> list:
    """The rules that no rule with some of their tokens and at least their confidence makes needless."""
    kept: list = []
    known: dict[str, list[tuple[frozenset, float]]] = {}
    for rule in sorted(rules, key=lambda r: (len(r[0]), -r[2], r[0])):
        own = frozenset(rule[0])
        shorter = [x for t in own for x in known.get(rule[1] + t, ())]
        if not any(c >= rule[2] and s < own for s, c in shorter):
            kept.append(rule)
            known.setdefault(rule[1] + min(own), []).append((own, rule[2]))
    return kept


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST, sample: int = SAMPLE) -> Mined:
    """Rules from tokens to a label, mined from ``labelled`` (url, label: allow or block; other labels teach nothing)."""
    items = transactions(labelled, support, most, sample)
    n = items.count()
    if not n:
        return Mined([])
    model = FPGrowth(itemsCol="items", minSupport=max(support, LEAST_ROWS / n), minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.startswith(F.get("consequent", 0), F.lit(LABEL))).select(
        F.sort_array("antecedent").alias("antecedent"), F.get("consequent", 0).alias("consequent"), "confidence", "support").collect()
    return Mined(general([(tuple(r.antecedent), r.consequent[len(LABEL):], r.confidence, r.support) for r in found]))


def judge(pages: DataFrame, rules: list[Rule], mined: Mined, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (of the list; null if none fits), mined (the association rule that fits best, as text; null if
    none) and verdict."""
    known = pages.sparkSession.sparkContext.broadcast(mined)
    at, own, won = F.col(url), fresh(pages, "_tokens"), fresh(pages, "_listed")
    parted = pages.withColumns({own: tokens(at), "host": host_of(at), "path": path_of(at)})
    found = parted.withColumn(won, listed(F.col("host"), F.col("path"), rules))
    ready = found.withColumns({"rule": F.col(won)["rule"], "mined": F.lit(None).cast("string"),
                               "verdict": F.substring(F.col(won)["verdict"], F.lit(2), F.lit(9))}).drop(won)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules_, best = known.value.rules, known.value.best
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            fits = [best(t) for t in columns.pop(own).to_pylist()]
            columns["mined"] = pa.array([None if i is None else " ".join(rules_[i][0]) + " -> " + rules_[i][1] for i in fits], pa.string())
            else_ = [ALLOW if i is None else rules_[i][1] for i in fits]
            columns["verdict"] = pa.array([v or e for v, e in zip(columns["verdict"].to_pylist(), else_, strict=True)], pa.string())
            yield pa.record_batch(list(columns.values()), list(columns))

    return ready.mapInArrow(run, ready.drop(own).schema)
