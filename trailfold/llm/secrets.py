"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived
that every match has to satisfy.  The index holds one posting (trigram, id)
for each trigram that some rule asks for and each document that has it;
postings are intersected and united per rule by the query, and only the
candidates are searched with the expression.  A rule without a mandatory
trigram searches every text.  DataFrame functions only.

Trigrams are looked up in the lower-cased text, so rules that ignore case need
no variants of them; a candidate more does no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailfold.llm.common import fresh, saved


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression (Java and Python alike), and a least length of a group (0: the match)."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A key from its BEGIN line to its END line; where there is none before the next such line, with the base64 (and the
#: headers of an encrypted key) that follow.  Possessive, so that the length of a key is no depth of recursion in Java.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"""|(?:(?:[\s"'+,>]|\\[rn])*+(?:[A-Za-z0-9+/]{24,}+={0,2}|(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]++={1,2})"""
    r"|\r?\n[ \t]*+[A-Za-z0-9+/]++(?![^\r\n]))*+)")
RULES = (
    Rule("assign", ASSIGN, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # a run of fewer digits is no match of either form, and a longer one is the same match
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Strings of which a part of an expression may consist before it is turned into a query.
MOST_STRINGS = 96

# ------------------------------------------------------------------ queries of trigrams

Clause = frozenset[str]


def trigram_query(pattern: str) -> list[Clause] | None:
    """Alternatives, each a set of trigrams that all have to be there; None: nothing is mandatory.

    Read from left to right: literals, small classes, groups, alternatives and
    optional parts are multiplied out to sets of strings; where a part is open
    (long classes, repetitions) the strings so far become a query.
    """
    query = _simplified(_of(re._parser.parse(pattern.lower()))[1])
    return query if query and all(query) else None


def _of(tree) -> tuple[set[str] | None, list[Clause]]:
    """(all strings that the part can match, or None; its query as alternatives)."""
    query: list[Clause] = [frozenset()]
    run: set[str] = {""}
    exact = True
    for kind, arg in tree:
        strings, inner = _part(str(kind), arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        query = _both(query, _grams(run))
        if strings is None:
            query, run = _both(query, inner), {""}
        else:
            run = strings
    return (run if exact else None), _both(query, _grams(run))


def _part(kind: str, arg) -> tuple[set[str] | None, list[Clause]]:
    anything: list[Clause] = [frozenset()]
    if kind == "LITERAL":
        return {chr(arg)}, anything
    if kind == "IN":
        chosen: set[str] = set()
        for k, a in arg:
            if str(k) == "LITERAL":
                chosen.add(chr(a))
            elif str(k) == "RANGE" and a[1] - a[0] < 8:
                chosen |= {chr(c) for c in range(a[0], a[1] + 1)}
            else:
                return None, anything
        return (chosen, anything) if len(chosen) <= 8 else (None, anything)
    if kind == "SUBPATTERN":
        return _of(arg[-1])
    if kind == "BRANCH":
        parts = [_of(t) for t in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*[s for s, _ in parts]), anything
        return None, _simplified([c for _, q in parts for c in q])
    if kind == "MAX_REPEAT":
        low, high, tree = arg
        strings, inner = _of(tree)
        if strings is not None and high == 1:
            return (strings | {""} if low == 0 else strings), anything
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            return reduce(lambda run, _: {a + b for a in run for b in strings}, range(low), {""}), anything
        return None, (inner if low else anything)
    return None, anything


def _grams(strings: set[str]) -> list[Clause]:
    return _simplified([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings])


def _both(a: list[Clause], b: list[Clause]) -> list[Clause]:
    return _simplified([x | y for x in a for y in b])


def _simplified(query: list[Clause]) -> list[Clause]:
    """Without alternatives that ask for more than another one."""
    kept: list[Clause] = []
    for c in sorted(set(query), key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in kept):
            kept.append(c)
    return kept


# ------------------------------------------------------------------ the index

def build_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (gram, id): one row for each listed trigram and row that has it; null texts have none."""
    listed = F.array(*[F.lit(g) for g in grams])
    has = F.get(F.transform(F.array(F.lower(docs[text_col])), lambda t: F.filter(listed, lambda g: F.contains(t, g))), F.lit(0))
    return docs.select(docs[id_col].alias("id"), F.explode(has).alias("gram"))


def candidates(postings: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """Ids with the rules (as an array) whose trigram query their postings satisfy."""
    grams = sorted({g for q in queries.values() for c in q for g in c})
    place = {g: i for i, g in enumerate(grams)}
    words = -(-len(grams) // 63)
    at = F.element_at(F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(place[g]))]), F.col("gram"))
    # a posting is one bit; all of an id are united before and after the shuffle
    bits = postings.select("id", at.alias("at")).select("id", *[
        F.when(F.floor(F.col("at") / 63) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at") % 63))
        .otherwise(F.lit(0).cast("bigint")).alias(f"b{w}") for w in range(words)])
    have = bits.groupBy("id").agg(*[F.bit_or(f"b{w}").alias(f"b{w}") for w in range(words)])

    def all_of(clause: Clause) -> Column:
        need = [sum(1 << (place[g] % 63) for g in clause if place[g] // 63 == w) for w in range(words)]
        return reduce(lambda a, b: a & b, [F.col(f"b{w}").bitwiseAND(F.lit(n)) == F.lit(n) for w, n in enumerate(need) if n])

    rules = [F.when(reduce(lambda a, b: a | b, [all_of(c) for c in q]), F.lit(kind)) for kind, q in queries.items()]
    return have.select("id", F.array_compact(F.array(*rules)).alias("rules")).filter(F.size("rules") > 0)


# ------------------------------------------------------------------ verification

def matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's leftmost matches that do not overlap, in code points.

    What lies between the matches and the matches themselves give the places.
    """
    empty = F.array().cast("array<struct<start:int,order:int,end:int>>")

    def of(found: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(found["between"], i))
            end = start + F.length(F.get(found["whole"], i))
            ok = F.length(F.get(found["checked"], i)) >= rule.least
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(ok, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
                            .alias("spans"))

        begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found["whole"]) - 1), begin, add, lambda s: s["spans"])

    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    found = F.struct(whole.alias("whole"), checked.alias("checked"), F.split(text, rule.pattern, -1).alias("between"))
    searched = F.get(F.transform(F.array(found), of), F.lit(0))
    return F.when(text.rlike(rule.pattern), searched).otherwise(empty)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
         out: str = "spans") -> DataFrame:
    """All columns of ``docs`` and ``out``: array of (start, order, end), sorted; ``order`` numbers the rules.

    The index is written to the shared checkpoint folder.  Every row gives
    one, repeated rows alike (an id's postings are those of all its rows; the
    expressions decide); a null text has no spans; rows with null ids share
    their postings.  A column named as ``out`` is replaced.
    """
    docs = docs.drop(out)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    text, asked = F.coalesce(F.col(names[text_col]), F.lit("")), F.lit(False)
    if queries:
        grams = sorted({g for q in queries.values() for c in q for g in c})
        index = saved(build_index(docs, grams, id_col, text_col))
        hits = candidates(index, queries)
        rows = rows.join(hits, rows[names[id_col]].eqNullSafe(hits["id"]), "left")
    parts = []
    for order, rule in enumerate(rules):
        spans = matches(text, rule, order)
        if rule.kind in queries:
            asked = F.coalesce(F.array_contains(F.col("rules"), rule.kind), F.lit(False))
            spans = F.when(asked, spans).otherwise(F.array().cast("array<struct<start:int,order:int,end:int>>"))
        parts.append(spans)
    found = rows.withColumn("spans", F.sort_array(F.concat(*parts)))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("spans").alias(out))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base rules, hash of their spans, and all spans as text."""
    found = find(docs.select(docs[id_col], docs[text_col]), rules, id_col, text_col)
    base = [i for i, r in enumerate(rules) if r.base]

    def number(order: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == order)).cast("long")

    of_base = F.filter("spans", lambda s: s["order"].isin(base))
    return found.select(
        id_col, *[number(i).alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(written(of_base, rules).cast("binary"), 256).alias("base_sha256"), written(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in the text replaced by ``mark`` (overlapping spans by one)."""
    columns = docs.columns
    spans = fresh("spans", columns)
    found = find(docs, rules, id_col, text_col, spans)
    text = F.col(text_col)

    def add(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        between = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, begin, add, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    done = found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text))
    return done.select(*columns)
