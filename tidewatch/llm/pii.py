"""Personal data by bootstrapped contextual extraction.

Plain patterns find e-mail addresses, IP addresses, card and phone numbers; these are the seeds. The words around a seed
are lexical patterns of its kind. The graph of patterns and the identifier-like strings (instances) they surround is
scored in rounds: a pattern's confidence is the share of its occurrences whose instance is known to be of a kind, an
unknown instance's score is the chance that one of its trusted patterns is right, and instances above a bound become
known for the next round. At last each trusted pattern marks the unknown instances it surrounds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import prepare
from tidewatch.session import materialise

KINDS = ("email", "ip", "card", "phone")
ROUNDS, LEAST_SEEDS, CONFIDENCE, ACCEPT = 3, 5, 0.8, 0.8
#: Longer words are no part of a lexical pattern.
WORD_CHARS = 40
#: Up to so many found spans (some 30 bytes each) go to every worker to mask texts; more are joined by a shuffle.
SENT_SPANS = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN, _DIGIT = re.compile("[0-9@]"), re.compile("[0-9]")
_TOKEN = re.compile(r"\S+")
_NUMBER = re.compile(r"[0-9()+./-]+[,;:]?")
_EDGE = " \t\n\r.,;:!?\"'()[]{}<>|"


def _luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(int(c) if i % 2 == 0 else double[int(c)] for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end (code points) and kind of the plain patterns' matches, by start, then kind as listed.

    Each kind is searched from left to right without overlaps; each search is linear in the text.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            out.append((begin, done, "email"))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
        out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def candidates(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of identifier-like strings outside the known ones: words with an @ or three digits, and rows of number words."""
    out: list[tuple[int, int]] = []
    covered = sorted((a, b) for a, b, _ in known)
    k, at = 0, _SIGN.search(text)
    while at:
        begin = at.start()
        while begin and not text[begin - 1].isspace():
            begin -= 1
        end = _TOKEN.match(text, at.start()).end()
        while _NUMBER.fullmatch(text, begin, end) and end + 1 < len(text) and text[end] == " ":
            more = _TOKEN.match(text, end + 1)
            if not more or not _NUMBER.fullmatch(more[0]):
                break
            end = more.end()
        low, high = begin, end
        while low < high and text[low] in _EDGE:
            low += 1
        while high > low and text[high - 1] in _EDGE:
            high -= 1
        while k < len(covered) and covered[k][1] <= low:
            k += 1
        if not (k < len(covered) and covered[k][0] < high) and ("@" in text[low:high] or len(_DIGIT.findall(text, low, high)) >= 3):
            out.append((low, high))
        at = _SIGN.search(text, end)
    return out


def contexts(text: str, begin: int, end: int) -> list[str]:
    """The lexical patterns that surround a span: two words before, the word before with the one after, two words after.

    A pattern with a digit, an @ or an overlong word is left out; the others stay.
    """
    before = text[max(0, begin - 3 * WORD_CHARS):begin].lower().split()[-2:]
    after = text[end:end + 3 * WORD_CHARS].lower().strip(".,;:!?\"')").split()[:2]
    before, after = ([w.strip(".,;!?\"'()") for w in ws] for ws in (before, after))
    every = [(before, [])] if len(before) == 2 else []
    every += [(before[-1:], after[:1])] if before and after else []
    every += [([], after)] if len(after) == 2 else []
    return [" ".join([*a, "_", *b]) for a, b in every if not any(len(w) > WORD_CHARS or _SIGN.search(w) for w in a + b)]


def _number(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, base, seen`` of every text, as a table: plain spans, and seeds and candidates with what surrounds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                every = [(a, b, kind) for a, b, kind in spans] + [(a, b, None) for a, b in candidates(text, spans)]
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                seen.append([{"start": a, "end": b, "kind": k, "instance": _number(text[a:b]), "patterns": contexts(text, a, b)} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], ["id", "base", "seen"])

    prepare(docs.sparkSession)
    span = "struct<start:long,end:long,kind:string>"
    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id long, base array<{span}>, seen array<struct<start:long,end:long,kind:string,instance:long,patterns:array<string>>>")
    return materialise(got.withColumn("row", F.monotonically_increasing_id()), "pii-seen")


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """``pattern, kind, confidence, support`` after scoring the graph of patterns and instances ``rounds`` times.

    ``seen`` has one row per occurrence: ``instance, kind`` (null: unknown) and ``pattern``. Repeated texts count an
    instance once per pattern. A pattern needs ``least_seeds`` different known instances of the kind.
    """
    edges = materialise(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    known = edges.filter("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0))
    for i in range(rounds):
        known = materialise(known, "pii-known")
        scored = edges.drop("kind").join(known, "instance", "left")
        kinds = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in KINDS]
        seeds = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in KINDS]
        totals = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"), *kinds, *seeds)
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("all")).alias("confidence"), F.col(f"n_{k}").alias("support")) for k in KINDS)))
        patterns = materialise(totals.select("pattern", each.alias("x")).select("pattern", "x.*").filter((F.col("confidence") >= confidence) & (F.col("support") >= least_seeds)),
                               "pii-patterns")
        if i + 1 < rounds:
            wrong = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
            found = (edges.drop("kind").join(known.select("instance"), "instance", "left_anti").join(patterns, "pattern").groupBy("instance")
                     .agg((1 - F.exp(wrong)).alias("score"), F.max_by("kind", "confidence").alias("kind")).filter(F.col("score") >= accept))
            known = known.unionByName(found.select("instance", "kind", "score"))
    return patterns


def found_spans(table: DataFrame, patterns: DataFrame) -> DataFrame:
    """``row, start, end, kind`` of unknown instances that a trusted pattern surrounds."""
    unknown = table.select("row", F.explode("seen").alias("s")).filter("s.kind is null").select("row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    return unknown.join(patterns, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` of every whole text: plain spans, and these with the discovered ones, as arrays by start and kind.

    Null and empty texts have no spans; rows with null ids and repeated rows give a row each; no rows give none; other
    columns are ignored. Discovered spans never overlap plain ones. ``id_col`` may not be ``base`` or ``spans``.
    """
    table = read(docs, id_col, text_col)
    occurrences = table.select(F.explode("seen").alias("s")).select("s.instance", "s.kind", F.explode("s.patterns").alias("pattern"))
    extra = (found_spans(table, trusted_patterns(occurrences)).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("extra")))
    whole = table.select("row", "id", "base").join(extra, "row", "left")
    every = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:long,end:long,kind:string>>")))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"),
                                                                  s["end"].alias("end"), s["kind"].alias("kind"))))
    return whole.select(F.col("id").alias(id_col), "base", ordered.alias("spans"))


def as_text(spans: str) -> F.Column:
    return F.concat_ws(",", F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets; overlapping spans become one.

    Every row is masked by what was found in its own text, whatever its id; null texts stay null.
    """
    keep, schema = docs.columns, docs.schema
    number, key, more = free_names(keep, "number", "found_in", "found")
    docs = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    spans = find(docs.select(F.col(number).alias("number"), F.col(text_col).alias("text")), "number", "text")
    extra = materialise(spans.filter(F.size("spans") > F.size("base")).select(F.col("number").alias(key), F.filter("spans", lambda s: ~F.exists("base", lambda b: (
        b["start"] == s["start"]) & (b["end"] == s["end"]) & (b["kind"] == s["kind"]))).alias(more)), "pii-extra")
    small = (extra.agg(F.sum(F.size(more))).first()[0] or 0) <= SENT_SPANS
    whole = docs.join(F.broadcast(extra) if small else extra, F.col(number) == F.col(key), "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(text_col).to_pylist(), batch.column(more).to_pylist()):
                texts.append(None if text is None else mask(text, base_spans(text) + [(s["start"], s["end"], s["kind"]) for s in found or []]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in keep], keep)

    return whole.mapInArrow(run, schema)


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names with as many underscores as it takes to differ from all taken ones, whatever their case."""
    lower = {t.lower() for t in taken}
    return [next(c for c in (n + "_" * k for k in range(len(taken) + 1)) if c not in lower) for n in names]


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, done = [], 0
    for a, b, kind in sorted(spans):
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])
