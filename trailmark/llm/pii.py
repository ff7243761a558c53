"""Personal data in texts: four exact kinds, and further identifiers that share their lexical contexts.

The exact kinds are the seeds. What stands around them gives patterns: the kind, and the label right before, or one or
two words before or after. Further instances have a relaxed form of a kind, which is the coarse shape that they share
with its seeds. Patterns and the instances they match form a bipartite graph, on which confidence is passed back and
forth: a pattern is as good as its instances and, if made of words, as the share of the words' places in all texts that
have such an instance; an instance is as good as its best pattern. Patterns that stay confident then mark what they
match and no exact kind has found.

Everything is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import row_key, stored

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# The same matches, without trying a long run again from each of its characters: a match begins where a run of its
# first characters does, or where the match before it ended. Groups that repeat without end give nothing back: such a
# repeat is a loop, where one that may is a call for each turn and fails on a long run. A domain has 127 parts at most.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: A text without these has no match; most have none.
_NEEDED = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
}

#: Rounds in which confidence is passed, the least confidence of a pattern that marks, and the least number of
#: different seeds it must have matched.
ROUNDS, CONFIDENT, SEEDS = 5, 0.8, 3
#: Relaxed forms of the kinds: broken, hidden or partial addresses and user names; dotted numbers out of range or with
#: places left out, and hexadecimal groups; digits without a right checksum; phones without a plus.
_FREE, _ENDS = r"(?<![\p{L}\p{N}_%+@.-])", r"(?![\p{L}\p{N}_@])"
_DOT = r"(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)"
_RELAXED = {
    "email": _FREE + r"(?:[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++){0,126}"
    r"|\x20at\x20[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++){1,126})"
    r"|(?=[A-Za-z0-9._-]*[0-9._][A-Za-z0-9]|[A-Za-z0-9._-]*[0-9])(?=[0-9._-]*[A-Za-z])[A-Za-z0-9](?:[._-]*[A-Za-z0-9])++)" + _ENDS,
    "ip": _FREE + r"(?:[0-9]++(?:\.[0-9]++){3}|[0-9]++\.[0-9]++(?:\.(?:[0-9]++|[xX*])){2}"
    r"|[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}+)" + r"(?![\p{L}\p{N}_@:])",
    "card": _FREE + r"(?:[0-9]{4}(?:[\x20-][0-9]{4,6}){2,4}+|[0-9]++(?:-[0-9]++)*+)" + _ENDS,
    "phone": r"(?<![\p{L}\p{N}_%@.-])(?:\+\x20?)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+" + _ENDS,
}
_RELAXED_NEEDED = {
    "email": r"@|[\[(]at[\])]|\x20at\x20|[A-Za-z][._-]*[0-9_]|[0-9_][._-]*[A-Za-z]|[A-Za-z]\.[A-Za-z]",
    "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": "[0-9]", "phone": "[0-9]",
}
#: Least characters of a relaxed match, and how far from it context words are looked for.
_LEAST, _NEAR = 5, 64
_BETWEEN_WORDS = r"[^\p{L}]+"
#: Matches whose places are added up together.
_TOGETHER = 64


_SPANS = "array<struct<start:int,kind:string,end:int,match:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's checksum is a multiple of ten."""
    n = F.length(digits)
    from_right = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int"))
    doubled = F.transform(
        from_right, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """What a match must meet besides the pattern."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(F.length(_digits(match)).between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of ``start``, ``kind``, ``end``, ``match`` (code points, end exclusive) of all matches.

    The gaps between matches and the matches themselves are laid end to end; their lengths give the places. Lengths are
    added up within parts of so many matches, then over parts, so the work doesn't grow with the square of the matches.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )

    def further(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def within(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), _none().alias("out")), further)

    def shifted(parts: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(
            parts,
            none,
            lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        moved = lambda s, b: F.struct(
            (s["start"] + b).alias("start"), s["kind"].alias("kind"), (s["end"] + b).alias("end"), s["match"].alias("match")
        )
        return F.flatten(F.zip_with(parts, begins, lambda p, b: F.transform(p["out"], lambda s: moved(s, b))))

    def places(found: Column) -> Column:
        last = F.floor((F.size(found) - 1) / F.lit(_TOGETHER)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: within(F.slice(found, i * _TOGETHER + 1, F.lit(_TOGETHER))))
        return F.when(F.size(found) > 0, _let(parts, shifted)).otherwise(_none())

    return _let(F.filter(pieces, lambda p: p["match"].isNotNull()), places)


def _exact(text: Column) -> Column:
    def of(kind: str) -> Column:
        holding = F.filter(_matches(text, _PATTERNS[kind], kind), lambda m: _holds(kind, m["match"]))
        return F.when(_NEEDED[kind](text), holding).otherwise(_none())

    return F.concat(*map(of, KINDS))


def _in_order(spans: Column) -> Column:
    """By start, then kind."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def _label_before(text: Column, start: Column) -> Column:
    """The label right before a place, a word that ends in a colon, equals sign or number sign, in lower case."""
    near = F.substring(text, F.greatest(start - 40, F.lit(0)) + 1, F.least(start, F.lit(40)))
    return F.lower(F.nullif(F.regexp_extract(near, r"([^\x20\x09-\x0D]*[A-Za-z][:=#])[\x20\x22]?$", 1), F.lit("")))


def find_exact(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` and ``base``: spans of the exact kinds, by start, then kind; see :func:`_matches`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("base", _in_order(_exact(text)))


def _candidates(text: Column, base: Column) -> Column:
    """Matches of the relaxed forms that overlap no exact span."""

    def of(kind: str) -> Column:
        like = F.filter(_matches(text, _RELAXED[kind], kind), lambda m: F.length(m["match"]) >= _LEAST)
        free = F.filter(like, lambda m: ~F.exists(base, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
        return F.when(F.rlike(text, F.lit(_RELAXED_NEEDED[kind])), free).otherwise(_none())

    return F.concat(*map(of, KINDS))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN_WORDS), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Each word with the one after it."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _contexts(text: Column, m: Column) -> Column:
    """What stands around a match: ``=`` and the label before, ``<`` and one or two words before, ``>`` and after.

    Words that the window cuts are left out.
    """
    start, end = m["start"], m["end"]
    left = _words(F.substring(text, F.greatest(start - _NEAR, F.lit(0)) + 1, F.least(start, F.lit(_NEAR))))
    right = _words(F.substring(text, end + 1, F.lit(_NEAR)))
    left = F.when(start > _NEAR, F.slice(left, F.lit(2), F.size(left))).otherwise(left)
    right = F.when(F.length(text) > end + _NEAR, F.slice(right, F.lit(1), F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    around = F.array(
        F.concat(F.lit("="), _label_before(text, start)),
        F.concat(F.lit("<"), F.try_element_at(left, F.lit(-1))),
        F.concat(F.lit("<"), F.try_element_at(_pairs(left), F.lit(-1))),
        F.concat(F.lit(">"), F.try_element_at(right, F.lit(1))),
        F.concat(F.lit(">"), F.try_element_at(_pairs(right), F.lit(1))),
    )
    return F.array_distinct(F.filter(around, lambda c: c.isNotNull()))


def _seeded(instances: DataFrame, texts: DataFrame, confident: float, least: int) -> DataFrame:
    """Patterns with enough seeds, and ``hit``: the share of their words' places in ``texts`` with such an instance.

    Patterns that this share alone keeps from being confident are left out. Labels have a share of 1.
    """
    each = instances.select("kind", "known", "match", F.explode("contexts").alias("context"))
    seeds = each.filter("known").select("kind", "context", "match").distinct()
    enough = seeds.groupBy("kind", "context").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    places = each.groupBy("kind", "context").agg(F.count("*").alias("places"))
    patterns = stored(
        enough.select("kind", "context").join(places, ["kind", "context"]).withColumn("words", F.expr("substring(context, 2)"))
    )
    sought = stored(patterns.filter("context NOT LIKE '=%'").select("words").distinct())
    words = texts.select(_words(F.col("text")).alias("w")).select(F.explode(F.concat("w", _pairs(F.col("w")))).alias("words"))
    seen = words.join(sought, "words").groupBy("words").agg(F.count("*").alias("seen"))
    hit = F.when(F.col("context").startswith("="), 1.0).otherwise(F.least(F.lit(1.0), F.col("places") / F.coalesce("seen", "places")))
    rated = patterns.join(seen, "words", "left").select("kind", "context", hit.alias("hit"))
    return stored(rated.filter(F.col("hit") >= confident))


def induced_patterns(
    instances: DataFrame, texts: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, least: int = SEEDS
) -> DataFrame:
    """Confident patterns ``kind``, ``context``, ``confidence`` of ``instances``, which stand in ``texts`` (``text``).

    An instance has ``kind``, ``known`` (of an exact kind), ``match`` and ``contexts``. A pattern's confidence is the
    mean of its instances', with one doubtful instance added, times its ``hit`` (see :func:`_seeded`). A seed's
    confidence is 1, another instance's that of its most confident pattern in the round before, at first 0. Patterns
    need ``least`` different seeds, and a value counts once for a pattern. Only instances that a pattern matches enter
    the rounds.
    """
    pattern = ["kind", "context"]
    seeded = _seeded(instances, texts, confident, least)
    each = instances.select("kind", "known", "match", F.explode("contexts").alias("context")).join(seeded, pattern)
    edges = stored(each.groupBy(*pattern, "match").agg(F.max(F.col("known").cast("double")).alias("seed"), F.max("hit").alias("hit")))
    confidence = (F.sum("score") / (F.count("*") + 1) * F.max("hit")).alias("confidence")
    scored = edges.withColumn("score", F.col("seed"))
    for _ in range(rounds):
        best = edges.join(scored.groupBy(*pattern).agg(confidence), pattern)
        best = best.groupBy("kind", "match").agg(F.max("confidence").alias("best"))
        scored = stored(edges.join(best, ["kind", "match"]).withColumn("score", F.greatest("seed", "best")).drop("best"))
    return scored.groupBy(*pattern).agg(confidence).filter(F.col("confidence") >= confident)


def find_personal_data(
    docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, least: int = SEEDS
) -> DataFrame:
    """Columns of ``docs`` with ``base`` and ``spans``: arrays of ``start``, ``kind``, ``end``, ``match``.

    ``base`` holds the exact kinds: leftmost matches of each kind's pattern that don't overlap, less those that fail
    the kind's rule. ``spans`` holds these and what confident patterns add (see :func:`induced_patterns`): matches of a
    kind's relaxed form beside a label or words that its seeds stand beside, where no exact span is. What begins at one
    place and has several forms is of the kind whose pattern is most confident. Both go by start, then kind. Places are
    code points, ends exclusive.

    A null text has no spans. Rows are independent in all but the patterns, and repeated rows get the same spans.
    Columns of ``docs`` named like the results, or ``_row``, are replaced. Without rows or seeds there are no patterns.

    The graph's instances are stored, a row for each; texts stay where they are and are read once more to count the
    words of patterns that have enough seeds. Spans to be added are joined to the documents by a hash of id and text,
    which Spark broadcasts while they are few.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = find_exact(docs.drop("base", "spans", "_row").withColumn("_row", row_key()))
    known = lambda spans, yes: F.transform(spans, lambda m: F.struct(m.alias("m"), F.lit(yes).alias("known")))
    both = F.concat(known(F.col("base"), True), known(_candidates(text, F.col("base")), False))
    each = found.select("_row", text.alias("text"), F.explode(both).alias("i"))
    instances = stored(
        each.select(
            "_row", "i.m", "i.known", F.col("i.m.kind").alias("kind"), F.col("i.m.match").alias("match"),
            _contexts(F.col("text"), F.col("i.m")).alias("contexts"),
        ).filter(F.size("contexts") > 0)
    )
    patterns = stored(induced_patterns(instances, docs.select(text.alias("text")), rounds, confident, least))
    matched = (
        instances.filter("NOT known").select("_row", "m", "kind", F.explode("contexts").alias("context"))
        .join(patterns, ["kind", "context"])
        .groupBy("_row", "m.start").agg(F.max_by("m", F.struct("confidence", F.length("m.match"), "kind")).alias("m"))
    )
    added = stored(matched.groupBy("_row").agg(F.collect_set("m").alias("_added")))
    joined = found.join(added, "_row", "left")
    return joined.withColumn(
        "spans", _in_order(F.concat("base", F.coalesce("_added", _none())))
    ).drop("_row", "_added")


def _listed(spans: str) -> Column:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first."""

    def further(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(F.concat(acc["out"], kept, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.aggregate("spans", begin, further, end)).otherwise(F.col("text")))
