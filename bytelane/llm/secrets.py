"""Secret scans over an inverted trigram index (DataFrame functions only).

1. Each rule's regex yields a Boolean trigram query (`trigrams.py`): a
   disjunction of trigram sets. Rules without mandatory trigrams scan fully.
2. The index holds a posting `(trigram, document)` for every trigram that a
   query asks for and that occurs in the lower-cased text.
3. Intersecting postings is relational division: a document is a candidate of
   a rule if, for one of its sets, it has as many postings as the set members.
   Postings are grouped by document and rule, so no list grows with the corpus.
4. Candidates are verified with the regex; spans are code points, end
   exclusive, leftmost and non-overlapping per rule.

Defined results: null texts count as empty; a null `doc_id` is an id like any
other; repeated rows and repeated ids give one result each (postings of equal
ids are united, which only adds candidates); an empty table gives no rows;
columns other than the id and the text are passed through by `find_spans`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelane.functions.arrays import let
from bytelane.llm.store import free_name
from bytelane.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value_group: int = 0  # the group whose length is checked
    value_chars: int = 0  # its least length; shorter matches are dropped
    base: bool = True
    sql: str | None = None  # the pattern in RE2 spelling, where it differs


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_RE2 = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)

# Order of the list = order of kinds among spans with equal starts. Runs of a
# class are matched whole, so the least length can stand in the pattern.
RULES = (
    Rule("assign", ASSIGN, 2, 6, sql=ASSIGN_RE2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", base=False),
)

SPAN = "array<struct<start:int,kind:int,end:int>>"


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """`(id, trigram)` for each listed trigram that occurs in the text."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    found = let(F.lower(text_col), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, rules)`: numbers of the indexed rules whose trigram query the document satisfies."""
    needs = [(r, a, t, len(s)) for r, rule in enumerate(rules)
             for a, s in enumerate(trigram_query(rule.pattern)) for t in sorted(s)]
    trigrams = sorted({t for _, _, t, _ in needs})
    asked = docs.sparkSession.createDataFrame(needs or [(-1, 0, "", 1)], "rule int, alternative int, trigram string, need int")
    # one row a rule, alternative and trigram: its size is that of the rules
    hits = postings(docs, trigrams, id_col, text_col).repartition(F.col(id_col)).join(F.broadcast(asked), "trigram")
    full = hits.groupBy(id_col, "rule", "alternative").agg(
        F.count_distinct("trigram").alias("have"), F.first("need").alias("need")).where("have = need")
    return full.groupBy(id_col).agg(F.collect_set("rule").alias("rules"))


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array, in blocks of about sqrt(n) elements."""

    def whole(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, size)).otherwise(F.expr("cast(array() as array<int>)"))

        def extend(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(F.element_at(acc, -1) + x))

        def total(b: Column) -> Column:
            return F.aggregate(F.slice(xs, b + 1, size), F.lit(0), lambda s, x: s + x)

        bases = F.aggregate(F.transform(starts, total), F.array(F.lit(0)), extend)
        return let(bases, lambda base: F.flatten(F.transform(starts, lambda b, i: F.slice(
            F.aggregate(F.slice(xs, b + 1, size), F.array(F.get(base, i)), extend), 2, size))))

    return let(numbers, whole)


def match_spans(text: Column, number: int, rule: Rule) -> Column:
    """Spans of all matches: the texts between them give their places."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group))

    def spans(found: Column) -> Column:
        def zipped(gaps: Column) -> Column:
            steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(g) + F.length(m))
            ends = running_sums(steps)
            return F.zip_with(found, ends, lambda m, e: F.struct(
                (e - F.length(m)).alias("start"), F.lit(number).alias("kind"), e.alias("end")))
        return let(between, zipped)

    out = let(matches, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(F.expr(f"cast(array() as {SPAN})")))
    if rule.value_chars:
        keep = F.zip_with(out, values, lambda s, v: F.when(F.length(v) >= rule.value_chars, s))
        out = F.filter(keep, lambda s: s.isNotNull())
    return out


def find_spans(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """`docs` with `out`: array of `(start, kind, end)`, kind = the rule's number, ordered by start, then kind.

    All columns of `docs` pass through, whatever their names; one that is named
    like `out` is refused.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {out!r} already")
    indexed = [bool(trigram_query(r.pattern)[0]) for r in rules]
    key, numbers = free_name(docs, "_candidate"), free_name(docs, "_rules")
    found = candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rules, "id", "text").select(
        F.col("id").alias(key), F.col("rules").alias(numbers))
    d = docs.join(found, docs[id_col].eqNullSafe(F.col(key)), "left").drop(key)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr(f"cast(array() as {SPAN})")
    parts = []
    for i, rule in enumerate(rules):
        spans = match_spans(text, i, rule)
        parts.append(free_name(docs, f"_s{i}"))
        d = d.withColumn(parts[-1], F.when(F.array_contains(numbers, F.lit(i)), spans).otherwise(none) if indexed[i] else spans)
    return d.withColumn(out, F.array_sort(F.concat(*parts))).drop(numbers, *parts)


def redact(docs: DataFrame, spans_col: str, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace every span by `mark`; overlapping and touching spans become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        joins = (F.size(acc["out"]) > 0) & (s["start"] <= acc["at"])
        end = F.greatest(acc["at"], s["end"])
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(
            F.struct(F.element_at(acc["out"], -1)["start"].alias("start"), end.alias("end"))))
        fresh = F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.struct(F.when(joins, end).otherwise(s["end"]).alias("at"), F.when(joins, grown).otherwise(fresh).alias("out"))

    merged = F.aggregate(spans_col, start, step)["out"]

    def cut(m: Column) -> Column:
        pieces = F.transform(m, lambda x, i: F.concat(
            F.substring(F.col(text_col), F.when(i == 0, 1).otherwise(F.get(m, i - 1)["end"] + 1),
                        x["start"] - F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"])), F.lit(mark)))
        tail = F.substring(F.col(text_col), F.element_at(m, -1)["end"] + 1, F.length(F.col(text_col)))
        return F.concat(F.array_join(pieces, ""), tail)

    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, let(merged, cut)).otherwise(F.col(text_col)))


def spans_text(spans: Column, rules=RULES) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
