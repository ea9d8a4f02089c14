"""Secret scans: a trigram inverted index finds candidate documents, regular expressions verify them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import cut, may_be_among, running_sums

MOST_STRINGS = 64
SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` 2 or 0 is what must have `least` characters; other matches are dropped."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0


# The three base rules of the contract, in its order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # The matches of [0-9a-f]+ are the longest runs, so asking for 16 here is the same as dropping the shorter ones.
    Rule("hex", r"[0-9a-f]{16,}"),
)
# What the method adds to them.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge_token", r"(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9+/_.=~-]{20,}"),
)
RULES = BASE + ADDED


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """The Boolean trigram query that a text must meet to match: all of the clauses, each by one of its sets of trigrams.

    Everything is lower case. Literals that follow each other are joined into strings, alternatives multiply them, and
    whatever may vary (classes, repeats) ends a string. A clause in which one string has no trigram says nothing and is left
    out, so a rule without mandatory trigrams gets an empty query.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> set[str]:
        sets = [frozenset(trigrams(s)) for s in strings]
        if all(sets):
            clauses.append(sorted(set(sets), key=sorted))
        return {""}

    def strings_of(nodes) -> set[str] | None:
        """All strings that nodes can be, or None if they aren't a few literals."""
        out = {""}
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg).lower()}
            elif name == "BRANCH":
                parts = [strings_of(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif name == "SUBPATTERN":
                more = strings_of(arg[3])
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                part = strings_of(arg[2])
                more = None if part is None else part | {""}
            else:
                more = None
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, more)}
        return out

    def walk(nodes) -> None:
        open_ = {""}
        for node in nodes:
            more = strings_of([node])
            if more is not None and "" not in more and len(open_) * len(more) <= MOST_STRINGS:
                open_ = {a + b for a, b in product(open_, more)}
                continue
            open_ = close(open_)
            if str(node[0]) == "SUBPATTERN":
                walk(node[1][3])
            elif str(node[0]) == "MAX_REPEAT" and node[1][0] > 0:
                walk(node[1][2])
        close(open_)

    walk(regex_parser.parse(regex))
    return clauses


def trigram_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index of the trigrams that queries ask for: a posting (trigram, doc_id) for each document that has it."""
    # in some locales, lower() gives a dotless i for I; a text is to be a candidate in all of them
    lowered = docs.select("doc_id", F.replace(F.lower("text"), F.lit("\u0131"), F.lit("i")).alias("_text"))
    has = [F.when(F.col("_text").contains(t), F.lit(t)) for t in wanted]
    return lowered.select("doc_id", F.explode(F.array_compact(F.array(*has))).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id and the kinds whose trigram query its postings meet."""
    terms = [
        (rule.kind, i, j, len(query), len(part), t)
        for rule in rules
        for query in [trigram_query(rule.regex)]
        for i, clause in enumerate(query)
        for j, part in enumerate(clause)
        for t in sorted(part)
    ]
    table = index.sparkSession.createDataFrame(terms, "kind string, clause int, part int, n_clauses int, n_terms int, trigram string")
    met = (
        index.join(F.broadcast(table), "trigram")  # a few rows for each rule
        .groupBy("doc_id", "kind", "clause", "part", "n_clauses", "n_terms")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = n_terms")
    )
    rules_met = met.groupBy("doc_id", "kind", "n_clauses").agg(F.count_distinct("clause").alias("n")).where("n = n_clauses")
    return rules_met.groupBy("doc_id").agg(F.collect_set("kind").alias("_kinds"))


def match_spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in a text, leftmost and not overlapping, as an array of (start, end) in code points."""
    hits = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.regex, -1)
    parts = F.zip_with(
        gaps,
        F.arrays_zip(hits.alias("hit"), kept.alias("kept")) if rule.group else F.transform(hits, lambda h: F.struct(h.alias("hit"), h.alias("kept"))),
        lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h["hit"]).alias("hit"), (F.length(h["kept"]) >= rule.least).alias("good")),
    )

    def span(part: Column, at: Column) -> Column:
        start = at + part["gap"]
        return F.when(part["good"], F.struct(start.cast("int").alias("start"), (start + part["hit"]).cast("int").alias("end")))

    # transform() binds the parts once
    spans = F.transform(
        F.array(parts), lambda ps: F.array_compact(F.zip_with(ps, running_sums(F.transform(ps, lambda p: p["gap"] + F.coalesce(p["hit"], F.lit(0)))), span))
    )[0]
    return F.when(text.rlike(rule.regex), spans).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and, for each rule, spans_<kind>: its matches' spans in every row of `docs` (doc_id, text).

    Rules with mandatory trigrams run only over the documents that the index gives for them; others run over all. Only the texts
    of candidates are shuffled: a bitmap of their ids keeps the others out. A null text is empty. Rows that repeat a doc_id are
    scanned each; they share postings, which only adds candidates. A null doc_id is an id like others. Other columns are not
    read. `docs` is read three times.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = [r for r in rules if trigram_query(r.regex)]
    wanted = sorted({t for r in indexed for clause in trigram_query(r.regex) for part in clause for t in part})
    found = cut(candidates(trigram_index(docs, wanted), indexed)).withColumnRenamed("doc_id", "_doc")
    told = may_be_among(docs, F.col("doc_id"), found.select("_doc"), "_maybe")
    some = told.where("_maybe").drop("_maybe")
    wide = some.join(found, some["doc_id"].eqNullSafe(found["_doc"]), "left")

    def spans(rule: Rule, candidate: bool) -> Column:
        if rule not in indexed:
            return match_spans(F.col("text"), rule)
        none = F.array().cast(SPANS)
        return F.when(F.array_contains("_kinds", rule.kind), match_spans(F.col("text"), rule)).otherwise(none) if candidate else none

    each = [rows.select("doc_id", *[spans(r, c).alias(f"spans_{r.kind}") for r in rules]) for rows, c in ((wide, True), (told.where("not _maybe"), False))]
    return each[0].unionByName(each[1])


def listed(rules: tuple[Rule, ...]) -> Column:
    """All spans of the rules as kind:start:end, by start, then in the rules' order, comma-joined."""

    def tagged(i: int, kind: str) -> Column:
        named = lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
        return F.transform(f"spans_{kind}", lambda s: F.struct(s["start"], F.lit(i).alias("i"), named(s).alias("span")))

    tagged_spans = [tagged(i, r.kind) for i, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged_spans)), lambda s: s["span"]), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of documents; see scan()."""
    counts = [F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scan(docs).select("doc_id", *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(RULES).alias("spans"))
