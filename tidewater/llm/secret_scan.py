"""Secret scans over a trigram inverted index, in DataFrame functions only.

1. Every rule's regular expression is parsed once on the driver into a Boolean trigram query
   (AND / OR over trigrams that any match must contain; TRUE where it has none).
2. The index holds one posting `(trigram, document)` for each trigram that some query names.
3. Postings are intersected per document: the set of trigrams found (bounded by the queries' trigrams)
   is tested against each query, giving the candidate rules of the document.
4. Candidates are verified by the regular expression itself; rules whose query is TRUE (hex runs) scan
   every document.

Defined results: a null text is the empty text and has no spans; repeated rows are scanned alike and each
gives a row; several rules may report overlapping spans; spans are code points, end exclusive; an empty
table gives an empty result. Input columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K  # the standard library's own regular-expression parse tree
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE = ("all",)


@dataclass(frozen=True)
class SecretRule:
    """`pattern` must mean the same to Python and Java; `group` must have `least` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = False


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds, then the kinds that this engine adds.
KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    SecretRule("assign", "(" + KEYWORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    SecretRule("access", "AKIA[A-Z0-9]+", 16, 0, True),
    SecretRule("hex", "[0-9a-f]+", 32, 0, True),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 32),
)


# --- Boolean trigram queries -------------------------------------------------------------------


def _both(a: tuple, b: tuple) -> tuple:
    parts = [x for x in (a, b) if x != TRUE]
    return ("and", *dict.fromkeys(parts)) if len(parts) > 1 else parts[0] if parts else TRUE


def _any_of(options: list[tuple]) -> tuple:
    options = list(dict.fromkeys(options))
    if TRUE in options:
        return TRUE
    return options[0] if len(options) == 1 else ("or", *options)


def _of_strings(strings: set[str]) -> tuple:
    """Some string of the set occurs: OR over strings of AND over their trigrams."""
    found = []
    for s in sorted(strings):
        q = TRUE
        for i in range(len(s) - 2):
            q = _both(q, ("tri", s[i : i + 3]))
        found.append(q)
    return _any_of(found) if found else TRUE


def _letters(items: list, limit: int = 4) -> set[str] | None:
    """The case-folded characters of a class, or None when there are too many to spell out."""
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value).lower())
        elif op is K.RANGE and value[1] - value[0] < 3:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if 0 < len(out) <= limit else None


def _walk(tree, limit: int = 16) -> tuple[set[str] | None, tuple]:
    """(all strings the part can match, or None; the query that any match satisfies)."""
    exact, query = {""}, TRUE

    def flush() -> None:
        nonlocal exact, query
        query, exact = _both(query, _of_strings(exact)), {""}

    whole = True
    for op, value in tree:
        options, need = None, TRUE
        if op is K.LITERAL:
            options = {chr(value).lower()}
        elif op is K.IN:
            options = _letters(value)
        elif op is K.SUBPATTERN:
            options, need = _walk(value[3], limit)
        elif op is K.BRANCH:
            parts = [_walk(x, limit) for x in value[1]]
            if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= limit:
                options = set().union(*(p[0] for p in parts))
            else:
                need = _any_of([p[1] for p in parts])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, most, inner = value
            strings, inner_need = _walk(inner, limit)
            if (least, most) == (0, 1) and strings is not None:
                options = strings | {""}
            elif least == most and strings is not None and len(strings) == 1 and least <= 64:
                options = {next(iter(strings)) * least}
            elif least > 0:
                need = inner_need
        elif op is K.AT:
            continue
        if options is not None and len(exact) * len(options) <= limit:
            exact = {a + b for a in exact for b in options}
            continue
        flush()
        if options is not None:
            exact = set(options)
        else:
            whole = False
            query = _both(query, need)
    final = _both(query, _of_strings(exact))
    return (exact if whole and query == TRUE else None), final


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of a regular expression, over lower-cased ASCII text."""
    tree = parser.parse(pattern)
    if any(ord(c) > 127 for c in pattern) or tree.state.flags & re.IGNORECASE:
        return TRUE  # folding beyond ASCII: scan fully
    return _walk(tree)[1]


def query_trigrams(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(query_trigrams(q) for q in query[1:])) if query != TRUE else set()


def _holds(query: tuple, found: Column) -> Column:
    if query == TRUE:
        return F.lit(True)
    if query[0] == "tri":
        return F.array_contains(found, query[1])
    out = _holds(query[1], found)
    for q in query[2:]:
        out = (out & _holds(q, found)) if query[0] == "and" else (out | _holds(q, found))
    return out


# --- index, candidates, verification -----------------------------------------------------------

_ASCII_UP, _ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: `(trigram, id, fingerprint)`, one row a trigram and document that has it."""
    folded = F.translate(F.col("__text"), _ASCII_UP, _ASCII_LOW)
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("__low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("__id", "__print", folded.alias("__low")).select(
        F.explode(present).alias("trigram"), "__id", "__print"
    )


def candidates(index: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """Intersects the postings: `(id, fingerprint, kinds)` for documents with a candidate rule."""
    found = index.groupBy("__id", "__print").agg(F.collect_set("trigram").alias("__found"))
    kinds = F.array_compact(
        F.array(*[F.when(_holds(trigram_query(r.pattern), F.col("__found")), F.lit(r.kind)) for r in rules])
    )
    return found.select("__id", "__print", kinds.alias("__kinds")).filter(F.size("__kinds") > 0)


def _spans(text: Column, rule: SecretRule, order: int) -> Column:
    """Leftmost, non-overlapping matches of the rule as structs, from the pieces between them."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(whole.alias("m"), part.alias("g"), between.alias("gap"))
    empty = F.array().cast("array<struct<start:long,kind_no:int,end:long,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        hit = F.struct(
            start.alias("start"), F.lit(order).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )
        grown = F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    return F.aggregate(
        F.filter(zipped, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        step,
        lambda acc: acc["out"],
    )


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, text, spans)`: all spans of each document, by start and then by the order of the rules."""
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    keyed = keyed.withColumn("__print", F.xxhash64("__text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != TRUE)
    trigrams = sorted(set().union(*(query_trigrams(trigram_query(r.pattern)) for r in indexed))) if indexed else []
    if trigrams:
        found = candidates(postings(keyed, trigrams), indexed)
        found = found.select(F.col("__id").alias("__cid"), F.col("__print").alias("__cprint"), "__kinds")
        keyed = keyed.join(found, F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__print") == F.col("__cprint")), "left")
    else:
        keyed = keyed.withColumn("__kinds", F.array().cast("array<string>"))
    empty = F.array().cast("array<struct<start:long,kind_no:int,end:long,kind:string>>")
    text, lists = F.col("__text"), []
    for order, rule in enumerate(rules):
        if rule in indexed:
            gate = F.array_contains(F.col("__kinds"), rule.kind)
        else:  # a long run is needed: one cheap test before the matches are cut out
            gate = text.rlike(_at_least(rule))
        lists.append(F.when(gate, _spans(text, rule, order)).otherwise(empty))
    return keyed.select(
        F.col("__id").alias(id_col), text.alias(text_col), F.sort_array(F.concat(*lists)).alias("spans")
    )


def _at_least(rule: SecretRule) -> str:
    """For a pattern that is one repeated class: the same class repeated `least` times, else itself."""
    simple = rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern)
    return f"{rule.pattern[:-1]}{{{rule.least}}}" if simple else rule.pattern


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with each secret's span replaced by `mask`; overlapping spans become one."""
    spans = F.col("__spans")
    own = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__own"), F.col(f"`{text_col}`").alias("__text"))
    scanned = scan(packed, id_col="__own", text_col="__text").withColumnRenamed("spans", "__spans")
    text = F.col("__text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.when(fresh, F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
        return F.struct(
            F.concat(acc["out"], F.coalesce(gap, F.lit(""))).alias("out"), F.greatest(acc["at"], s["end"]).alias("at")
        )

    cleaned = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        step,
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    out = scanned.select(F.col("__own"), F.when(F.size(spans) > 0, cleaned).otherwise(text).alias(text_col))
    return out.select(*[out["__own"][c].alias(c) if c != text_col else F.col(f"`{text_col}`") for c in docs.columns])
