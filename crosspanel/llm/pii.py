"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  These spans, and long hexadecimal strings,
are seed entities.  The two words before an identifier-like token, and the words on either side, are its lexical patterns.  Spark
scores the graph of patterns and instances iteratively: a pattern is as good as the instances it introduces, an instance as good as
its patterns, and good instances support patterns as seeds do.  High-confidence patterns then mark identifiers of a form that no fixed
pattern knows, as spans of kind ``id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm._rows import checkpoint, fresh, map_rows, table

#: Kinds in their order; ``id`` is what the contexts add.
KINDS = ("email", "ip", "card", "phone", "id")
#: Rounds of scoring, least confidence of a pattern, distinct seed instances that it needs, damping of rare patterns.
ROUNDS, CONFIDENCE, SUPPORT, DAMPING = 4, 0.5, 3, 1.0
#: Characters of a candidate at least.
LEAST = 5

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS, _HEX = re.compile(r"[0-9]+"), re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
#: Characters that end a token, and those that are no part of one at its ends.
_CUTS, _EDGE = "=:,;\"'`()[]{}<>|", ".!?#*$%&"
_BREAK = re.compile(rf"[\s{re.escape(_CUTS)}]")
_WORD = re.compile(rf"[^\s{re.escape(_CUTS)}]+|[=:]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @, so it is found from there; its start is the leftmost character that may belong to it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # Characters before a failed @ can't belong to a later match: the class has no @.
        done = found.end() if found else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns in code points, by kind and start.  Null: none."""
    if not text:
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before a token, and the word on either side.  Lower case, digits as 0; ``^`` and ``$`` stand for the text's ends."""
    words = [x[-20:].lower() for x in _WORD.findall(text[max(0, start - 80) : start])[-2:]]
    words = ["^", *words] if len(words) < 2 and start <= 80 else words
    behind = _WORD.search(text[end : end + 40])
    after = behind.group()[:20].lower() if behind else "$"
    return _DIGITS.sub("0", " ".join(words)), _DIGITS.sub("0", f"{words[-1] if words else ''} _ {after}")


def candidates(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[str, str, str, int, int, int]]:
    """(two patterns, instance, start, end, kind) of the base spans (kind 2) and of other tokens with a digit and LEAST characters.

    Tokens end at white space and at the characters in _CUTS.  Kind 1 is a seed, 0 is unknown.
    """
    if not text:
        return []
    out = [(*_near(text, s, e), text[s:e], s, e, 2) for _, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    at, done = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and not (text[start - 1].isspace() or text[start - 1] in _CUTS):
            start -= 1
        found = _BREAK.search(text, end)
        done = end = found.start() if found else len(text)
        word = text[start:end]
        end -= len(word) - len(word.rstrip(_EDGE))
        start += len(word) - len(word.lstrip(_EDGE))
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if end - start >= LEAST and not (at < len(taken) and taken[at][0] < end):
            word = text[start:end]
            out.append((*_near(text, start, end), word[:200], start, end, int(_HEX.fullmatch(word) is not None)))
    return out


def _key(text_col: str):
    """Texts are told apart by hash and length, so that copies share what is found in them."""
    text = F.col(f"`{text_col}`")
    return F.concat_ws(":", F.xxhash64(text), F.length(text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, key, base as kind:start:end, and arrays of the candidates) per row of docs.

    Lists of strings are joined by "\\x00", kinds are a digit each.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, keys, texts in batches:
            rows = []
            for key, k, text in zip(ids, keys, texts, strict=True):
                base = base_spans(text)
                found = list(zip(*candidates(text, base), strict=True)) or [()] * 6
                strings = ("\x00".join(x.replace("\x00", " ") for x in c) for c in found[:3])
                rows.append((key, k, ",".join(f"{a}:{s}:{e}" for a, s, e in base), *strings, list(found[3]), list(found[4]), "".join(map(str, found[5]))))
            yield [list(c) for c in zip(*rows, strict=True)]

    ready = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _key(text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    schema = "id long, key string, base string, befores string, arounds string, words string, starts array<int>, ends array<int>, kinds string"
    return map_rows(ready, ["id", "key", "text"], schema, run)


def learn_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of the good patterns in ``found`` (key, pattern, word, kind).  Copies of a text count once.

    Each round a pattern needs SUPPORT distinct instances that are seeds or that the round before found with CONFIDENCE, so what good
    patterns discover makes patterns of its own.  A pattern's confidence is the mean score of its instances, an instance's score the
    noisy or of its patterns.
    """
    edges = checkpoint(found.groupBy("pattern", "word").agg(F.max(F.col("kind") > 0).cast("double").alias("seed"), F.log1p(F.countDistinct("key")).alias("w")))
    # A pattern with fewer instances than SUPPORT can never have enough of them.
    many = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select("pattern")
    edges = checkpoint(edges.join(many, "pattern", "left_semi"))
    scores = edges.groupBy("word").agg(F.max("seed").alias("score"))
    for _ in range(rounds):
        patterns = edges.join(scores, "word").groupBy("pattern").agg(
            (F.sum(F.col("w") * F.col("score")) / (F.sum("w") + DAMPING)).alias("confidence"), F.count_if(F.col("score") >= CONFIDENCE).alias("support")
        )
        patterns = checkpoint(patterns.filter(F.col("support") >= SUPPORT).select("pattern", "confidence"))
        noisy_or = 1 - F.exp(F.sum(F.log(1 - F.coalesce("confidence", F.lit(0.0)) * 0.99)))
        scores = edges.join(patterns, "pattern", "left").groupBy("word").agg(F.greatest(F.max("seed"), noisy_or).alias("score"))
    return patterns.filter(F.col("confidence") >= CONFIDENCE)


def contextual_spans(scanned: DataFrame) -> DataFrame:
    """(key, extra): for each text with any, its added spans in order of their starts."""
    split = [F.split(c, "\x00").alias(n) for c, n in (("befores", "before"), ("arounds", "around"), ("words", "word"))]
    rows = scanned.filter(F.size("starts") > 0).select("key", *split, F.col("starts").alias("start"), F.col("ends").alias("end"), F.split("kinds", "").alias("kind"))
    rows = rows.select("key", F.inline(F.arrays_zip("before", "around", "word", "start", "end", "kind"))).filter("start is not null")
    both = F.explode(F.array(F.concat(F.lit("2:"), "before"), F.concat(F.lit("1:"), "around"))).alias("pattern")
    found = rows.select("key", both, "word", "start", "end", F.col("kind").cast("int").alias("kind"))
    patterns = learn_patterns(found)
    span = F.format_string("id:%d:%d", "start", "end")
    new = found.filter("kind < 2").join(patterns, "pattern", "left_semi").groupBy("key", "start", "end").agg(F.first(span).alias("span"))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("start", "span"))), lambda x: x["span"])
    return new.groupBy("key").agg(F.array_join(spans, ",").alias("extra"))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, key, base, spans) per row of docs: comma-joined kind:start:end, the fixed patterns' and all.

    Null and empty texts have none.  Copies get the same spans; null and repeated ids do no harm.  Of spans that start together the
    base's come first.  A long text is one row's memory, and its candidates are rows of their own.  An empty table gives an empty
    result.  The scan is written once to the shared folder, then read for the patterns and for the result.
    """
    scanned = table(scan(docs, id_col, text_col), "pii")
    extra = contextual_spans(scanned)
    spans = F.array_join(F.filter(F.array("base", "extra"), lambda x: F.length(x) > 0), ",")
    return scanned.select("id", "key", "base").join(extra, "key", "left").select(F.col("id").alias(id_col), "key", "base", spans.alias("spans"))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first (then the longest) counts."""
    if not text or not spans:
        return text
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
            done = e
    return "".join([*out, text[done:]])


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the private spans of the text replaced; all other columns and rows stay as they are, whatever their names.

    What the contexts add is joined by the text's key, so neither nulls nor repeated ids matter.  Null texts stay null.
    """
    scanned = table(scan(docs, id_col, text_col), "pii")
    key, more = fresh(docs, "pii_key"), fresh(docs, "pii_more")
    extra = contextual_spans(scanned).select(F.col("key").alias(key), F.col("extra").alias(more))

    @F.pandas_udf("string")
    def clean(texts, extras):
        def one(text, more):
            added = [("id", int(s), int(e)) for _, s, e in (x.split(":") for x in more.split(","))] if more else []
            return redact(text, base_spans(text) + added)

        return texts.combine(extras, one)

    found = docs.withColumn(key, _key(text_col)).join(extra, key, "left")
    text = clean(F.col(f"`{text_col}`"), F.col(more)).alias(text_col)
    return found.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
