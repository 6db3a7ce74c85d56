"""PII by bootstrapped contextual extraction: seeds, patterns of their contexts, pattern-instance graph scores."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs so many different seeds or instances accepted in an earlier round, and this score; an instance this score to be extracted.
SUPPORT, PATTERN, INSTANCE = 5, 0.8, 0.8
#: Digits that make a token or groups of digits outside the seeds a candidate: fewer than any card or phone has. E-mail-like
#: and address-like forms need none but their own.
DIGITS = 7
#: Groups of more digits than any kind has are no single identifier.
MOST_DIGITS = 19

# Each expression matches what its plain form matches. A run that fails is left as a whole, so time grows with the text.
_EMAIL_LATER = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_REST = re.compile(r"[A-Za-z0-9@.+()_:-]*+")
_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+()_:-")
#: Length of the longest candidate: a mailbox's 64 letters, the sign and a domain's 255 (RFC 5321); no other kind is longer.
LONG = 320
_AT = re.compile(r" ?(?:@|[(\[{] ?[Aa][Tt] ?[)\]}]) ?| at (?=[^\s@]{1,64}(?:\.[A-Za-z]| dot |[(\[{]dot))")
_LOCAL = re.compile(r"[^\s@<>()\[\]{},;:\"'|/]{1,64}\Z")
_DOMAIN = re.compile(r"[^\s@<>()\[\]{},;:\"'|/]{1,255}(?:(?: dot | ?[(\[{]dot[)\]}] ?)[^\s@<>()\[\]{},;:\"'|/]{1,63}){0,4}")
_QUAD = re.compile(r"(?<![A-Za-z0-9@_.-])[0-9]++(?:\.[0-9]++)++(?![A-Za-z0-9@_-])")
_GROUPS = re.compile(r"(?<![A-Za-z0-9@._:-])(?:\+ ?)?\(?[0-9]++(?:(?:[ .-]|\)[ -]?|[ -]?\()[0-9]++)++")
_PLAIN_GROUPS = re.compile(r"[0-9+() .-]*")
_PLAIN_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")


def _emails(text: str):
    at = 0
    while True:
        m = _EMAIL_HERE.match(text, at) if at else None  # what follows a match may start inside a run
        m = m or _EMAIL_LATER.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in code points, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _IP_HINT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


_IP_HINT = re.compile("[0-9]")


def _shape(value: str) -> str:
    """Letter classes of a value, runs as one sign with a rough length."""
    out = []
    for m in re.finditer(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]", value):
        x = m.group()
        out.append((f"9{len(x)}" if len(x) <= 4 or len(x) >= 12 else "9") if x[0].isdigit() else "a" if x[0].isalpha() else x)
    return _short("".join(out), 64)


def _short(value: str, most: int) -> str:
    """value, or where it is longer its digest: different values stay different."""
    return value if len(value) <= most else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def _general(value: str) -> str:
    """The shape's class, whatever the lengths and signs between: `@` word at word, `#.#.#.#` or `#` digit groups; else empty."""
    if _PLAIN_QUAD.fullmatch(value):
        return "#.#.#.#"
    if _PLAIN_GROUPS.fullmatch(value):
        return "#"
    return "@" if _AT.search(value) else ""


def _context(text: str, a: int, b: int) -> tuple[str, str]:
    """The words beside a span, lower-cased; empty at a line's end. Of a long word the 32 letters next to the span tell it."""
    left = text[max(0, a - 48) : a].rsplit("\n", 1)[-1].split()
    right = text[b : b + 48].split("\n", 1)[0].split()
    return (left[-1].lower()[-32:] if left else ""), (right[0].lower()[:32] if right else "")


def _tokens(text: str):
    """Spans of the runs of letters, digits and signs that hold a digit and whose first digit is near their start."""
    end = 0
    for m in _NUMBER.finditer(text):
        a = m.start()
        if a < end:
            continue
        low = max(end, a - LONG - 1)
        while a > low and text[a - 1] in _SIGNS:
            a -= 1
        end = _REST.match(text, m.end()).end()
        yield a, end


def _candidates(text: str):
    """Spans that may be unseen instances, by start, none over another: word at word, four dotted numbers, groups, tokens."""
    found: list[tuple[int, int]] = []
    last = 0
    for m in _AT.finditer(text):
        low = max(last, m.start() - 64)
        a = _LOCAL.search(text[low : m.start()])
        b = _DOMAIN.match(text, m.end())
        if a and b:
            start, end = low + a.start(), b.end()
            while end > m.end() and text[end - 1] in ".!?-_*":
                end -= 1
            while start < m.start() and text[start] in ".-_*":
                start += 1
            if start < m.start() and end > m.end():
                found.append((start, end))
                last = end
    if _IP_HINT.search(text):
        quads = [m.span() for m in _QUAD.finditer(text) if m.group().count(".") == 3]
        groups = []
        for m in _GROUPS.finditer(text):
            after = text[m.end() : m.end() + 1]
            if DIGITS <= sum(c.isdigit() for c in m.group()) <= MOST_DIGITS and not (after.isalnum() or after in ("@", "_")):
                groups.append(m.span())
        tokens = []
        for a, b in _tokens(text):
            while b > a and text[b - 1] in ".:-_(":
                b -= 1
            while a < b and text[a] in ".:-_)":
                a += 1
            if sum(c.isdigit() for c in text[a:b]) >= DIGITS:
                tokens.append((a, b))
        for more in (quads, groups, tokens):
            found = _beside(found, more)
    return [x for x in found if x[1] - x[0] <= LONG]


def _beside(first: list, more: list) -> list:
    """first and those of more that overlap none of them, by start; neither list overlaps itself."""
    out, i = [], 0
    for a, b in more:
        while i < len(first) and first[i][1] <= a:
            i += 1
        if i >= len(first) or first[i][0] >= b:
            out.append((a, b))
    return sorted(first + out)


def found_in(text: str) -> tuple[list, list]:
    """Base spans (start, kind, end) and mentions (kind or -1, start, end, value, patterns) of one text."""
    spans = base_spans(text)
    mentions = []
    taken, last = [], 0
    for a, _, b in spans:
        taken.append((a, b))

    def tell(kind, a, b):
        left, right = _context(text, a, b)
        value = _short(text[a:b].lower(), 128)
        shape, general = _shape(text[a:b]), _general(text[a:b])
        patterns = [f"L {left} {shape}", f"R {right} {shape}"]
        patterns += [f"{side} {word} ~{general}" for side, word in (("L", left), ("R", right)) if general and word]
        mentions.append((kind, a, b, value, patterns))

    for a, kind, b in spans:
        tell(kind, a, b)
    i = 0
    for a, b in _candidates(text):
        while i < len(taken) and max(taken[i][1], last) <= a:
            last = max(last, taken[i][1])
            i += 1
        if last <= a and (i >= len(taken) or taken[i][0] >= b):
            tell(-1, a, b)
    return spans, mentions


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of (start, kind, end) in code points, end exclusive.

    kind is a position in KINDS. base holds the spans of the plain expressions, the seeds. Each mention of a seed
    or of a candidate is an instance with up to four patterns: the word before it or after it, each with its shape, and with
    its shape's class (word at word, dotted numbers, digit groups) where there is such a word.
    In rounds, a pattern's score for a kind is the smoothed mean score of its different instances, and an instance's the
    best of its patterns'. Unseen instances that trusted patterns score highly are added where they stand;
    they never overlap a base span. Candidates are words at words, dotted numbers, and groups or tokens of DIGITS digits or more,
    up to LONG characters; base spans may have any length. Null and empty texts have no spans; repeated rows repeat, but a value counts once for
    a pattern; empty tables give no rows; other columns are ignored. All statistics cover all documents; counting
    pre-aggregates, and nothing of the graph is gathered on the driver.
    """

    def work(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        said = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            base, mentions = [], []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    spans, found = found_in(text or "")
                    base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                    mentions.append([dict(zip(("kind", "start", "end", "value", "patterns"), x)) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(mentions, said)], names=["doc_id", "base", "mentions"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.arrow_map(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work,
        f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, mentions array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>",
    )
    rows = common.cut(rows.withColumn("row", F.monotonically_increasing_id()), "mentions")
    each = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = common.cut(each.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    score = None
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.when(F.col("kind") == k, 1.0).otherwise(0.0))
    names = [f"s{k}" for k in range(len(KINDS))]
    for r in range(rounds):
        if score is None:
            known = edges.select("pattern", "value", "kind", *[one_hot[k].alias(n) for k, n in enumerate(names)])
        else:
            known = edges.join(score, "value", "left").select("pattern", "value", "kind", *[F.when(F.col("kind") >= 0, one_hot[k]).otherwise(F.coalesce(n, F.lit(0.0))).alias(n) for k, n in enumerate(names)])
        # a pattern of unseen instances alone tells nothing about them
        patterns = known.groupBy("pattern").agg(
            *[(F.sum(n) / (F.sum(F.when((F.col("kind") >= 0) | (F.col(n) > 0), 1.0).otherwise(0.5)) + 1)).alias(n) for n in names],
            *[F.count(F.when(F.col(n) >= INSTANCE, 1)).alias(f"c{k}") for k, n in enumerate(names)],  # seeds, and instances accepted in an earlier round
        )
        for k, n in enumerate(names):
            patterns = patterns.withColumn(n, F.when((F.col(f"c{k}") >= SUPPORT) & (F.col(n) >= PATTERN), F.col(n)).otherwise(0.0))
        trusted = common.broadcast_if_small(common.cut(patterns.where(" OR ".join(f"{n} > 0" for n in names)).select("pattern", *names), "patterns"))
        score = common.cut(edges.where("kind < 0").join(trusted, "pattern").groupBy("value").agg(*[F.max(n).alias(n) for n in names]), "scores")
    top = F.greatest(*names)
    best = F.when(F.col(names[0]) == top, 0)
    for k, n in enumerate(names[1:], 1):
        best = best.when(F.col(n) == top, k)
    accepted = score.where(top >= INSTANCE).select("value", best.alias("as"))
    added = each.where("kind < 0").join(common.broadcast_if_small(accepted), "value").groupBy("row").agg(F.collect_list(F.struct("start", F.col("as").alias("kind"), "end")).alias("added"))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", nothing).alias("added"))


def spell(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.read(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(F.encode(spell(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spell(F.concat("base", "added")).alias("spans"))
