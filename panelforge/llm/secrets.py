"""Secret scans over a trigram index, DataFrame functions only.

A rule's regex is read into a Boolean trigram query: an OR of ANDs of trigrams that every
match must hold (of the lower-cased text). The index has one posting (trigram, document)
for each trigram that some rule asks for. Intersecting a clause's postings is counting its
trigrams by document; documents that meet a clause are the rule's candidates, and only they
are searched with its regex. A rule without mandatory trigrams is searched everywhere.

All matches of a rule are found leftmost first, without overlap, in one scan; positions are
running sums over the pieces between the matches, taken block by block so that a text with
very many matches copies no growing list at each. Positions are code points, end exclusive.

Nulls: a null text is empty. Documents that share an id (or have none) share postings, which
adds candidates and never loses one; each row is then searched by itself, so equal rows give
equal results. Rows without an id are searched by every rule. Very long texts are searched
whole. Empty tables give empty results. All columns pass; if one is called ``found`` already,
the result is ``found_2`` (or the next free name).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # Python 3.10
    import sre_constants as sre
    import sre_parse as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import doc_key, if_small, need, own_names, stored

#: Strings that a part of a regex may stand for before it counts as unknown.
MOST_STRINGS = 32
#: Matches whose positions are added up in one go.
PIECES = 256


@dataclass(frozen=True)
class Rule:
    """kind, a regex that Java and Python read alike, the group whose length is held against
    ``least`` code points, and whether letters match in either case."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    any_case: bool = False


# The base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Further public token formats, found beside the base rules.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses, one of which every match meets by holding all its trigrams. An empty list:
    nothing is mandatory."""

    def strings(item) -> set[str] | None:
        """All strings this part may match, or None if they are too many."""
        what, value = item
        if what is sre.LITERAL:
            return {chr(value).lower()}
        if what is sre.IN:
            found = set()
            for kind, v in value:
                if kind is sre.LITERAL:
                    found.add(chr(v).lower())
                elif kind is sre.RANGE and v[1] - v[0] < MOST_STRINGS:
                    found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return None
            return found if len(found) <= 4 else None
        if what is sre.SUBPATTERN:
            return sequence(value[-1])
        if what is sre.BRANCH:
            parts = [sequence(p) for p in value[1]]
            return None if None in parts else set().union(*parts)
        if what in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] != sre.MAXREPEAT and value[1] <= 3:
            once = sequence(value[2])
            if once is None:
                return None
            found, now = set(), {""}
            for k in range(value[1] + 1):
                if k >= value[0]:
                    found |= now
                now = {a + b for a in now for b in once}
            return found if len(found) <= MOST_STRINGS else None
        return None

    def sequence(items) -> set[str] | None:
        now = {""}
        for item in items:
            part = strings(item)
            if part is None or len(now) * len(part) > MOST_STRINGS:
                return None
            now = {a + b for a in now for b in part}
        return now

    best: set[str] = set()

    def weight(found: set[str]) -> int:
        return min((len(trigrams(s)) for s in found), default=0)

    now = {""}
    for item in parser.parse(regex):
        part = strings(item)
        if part is None or len(now) * len(part) > MOST_STRINGS:
            best = max(best, now, key=weight)
            now = {""} if part is None else part
        else:
            now = {a + b for a in now for b in part}
    best = max(best, now, key=weight)
    return sorted({trigrams(s) for s in best}, key=sorted) if weight(best) else []


def trigram_index(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """Postings (trigram, d) of the wanted trigrams in the lower-cased text."""
    low = docs.select(doc_key().alias("d"), F.lower(text).alias("_low"))
    held = F.filter(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    return low.select("d", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(d, kinds): the rules with mandatory trigrams that a document may match."""
    spark = docs.sparkSession
    clauses = [(r.kind, i, sorted(c)) for r in rules for i, c in enumerate(trigram_query(r.regex))]
    terms = spark.createDataFrame([(f"{k}/{i}", k, len(c), t) for k, i, c in clauses for t in c], "clause string, kind string, size int, trigram string")
    postings = trigram_index(docs, sorted({t for _, _, c in clauses for t in c}))
    # The terms are as many as the rules ask for, whatever the data.
    met = postings.join(F.broadcast(terms), "trigram").groupBy("d", "clause", "kind", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("d").agg(F.collect_set("kind").alias("kinds"))


def find_all(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches that are long enough."""
    pattern = ("(?i)" if rule.any_case else "") + rule.regex
    regex, none = F.lit(pattern), F.array().cast("array<struct<start:int,end:int,kind:string>>")
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    held = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    pieces = F.arrays_zip(gaps.alias("gap"), whole.alias("match"), held.alias("held"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["gap"])
        end = begin + F.char_length(p["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        spans = F.when(F.char_length(p["held"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def shifted(block: Column, by: Column) -> Column:
        return F.transform(block["spans"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["kind"].alias("kind")))

    # Blocks of pieces are laid out by themselves and then moved to where the block begins, so
    # that no growing array is copied at every match. A lambda's argument is computed once.
    def blocks(pieces: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(PIECES))
        return F.transform(starts, lambda i: F.aggregate(F.slice(pieces, i, F.lit(PIECES)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def placed(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
        bases = F.aggregate(blocks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")))["bases"]
        return F.flatten(F.zip_with(blocks, bases, shifted))

    laid = F.get(F.transform(F.transform(F.array(pieces), blocks), placed), F.lit(0))
    return F.when(F.regexp_like(text, regex), laid).otherwise(none)


def quick(rule: Rule) -> Rule:
    """A rule that is one repeated class and has a least length matches the same with the
    length inside: the run is taken whole, from its start. This saves making every short run."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]\\]+\]\+", rule.regex):
        return Rule(rule.kind, f"{rule.regex[:-1]}{{{rule.least},}}", 0, 0, rule.any_case)
    return rule


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents with ``found``: array<struct<start, end, kind>>, by start, then in the
    order of the rules."""
    need(docs, "doc_id", text)
    own, (into, d, kinds) = docs.columns, own_names(docs, "found", "_d", "_kinds")
    cands = stored(candidates(docs.where("doc_id is not null"), rules).select(F.col("d").alias(d), F.col("kinds").alias(kinds)), "candidates")
    # Narrow, so no text moves while it is small; rows without an id are searched by all rules.
    cands = if_small(cands, 64 + sum(16 + len(r.kind) for r in rules))
    rows = docs.join(cands, F.col("doc_id").cast("long") == F.col(d), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for r in rules:
        hits = find_all(body, quick(r))
        if trigram_query(r.regex):
            hits = F.when(F.col("doc_id").isNull() | F.array_contains(kinds, r.kind), hits).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))
        parts.append(hits)
    order = [r.kind for r in rules]

    def rank(k: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, order)), k)

    found = F.array_sort(F.transform(F.concat(*parts), lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return rows.select(*own, F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias(into))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_secrets(docs).select("doc_id", "found")
    base = F.filter("found", lambda x: x["kind"].isin(*[r.kind for r in BASE]))

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
