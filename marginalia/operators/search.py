"""Search operators: plans over postings; every result carries totals, so that incomplete is never mistaken for empty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.folds import verse_fold
from marginalia.functions.text import bounded_levenshtein, occurrences
from marginalia.plans.views import folded


@dataclass(frozen=True)
class Query:
    phrase: str
    excluded: tuple[str, ...] = ()


def parse_query(raw: str, fold=lambda s: " ".join(s.lower().split()), most: int = 1024) -> Query:
    """Quoted phrases, -exclusions and backslash escapes; exclusions are folded, those of equal fold count once."""
    if len(raw) > most:
        raise ValueError(f"a query has at most {most} characters")
    words: list[tuple[str, bool]] = []
    now, quoted, minus, i = "", False, False, 0
    while i <= len(raw):
        c = raw[i] if i < len(raw) else None
        if c == "\\" and i + 1 < len(raw):
            now, i = now + raw[i + 1], i + 1
        elif c == '"':
            quoted = not quoted
        elif c is None or (c.isspace() and not quoted):
            if now:
                words.append((now, minus))
            now, minus = "", False
        elif c == "-" and not now and not quoted and not minus:
            minus = True
        else:
            now += c
        i += 1
    seen: dict[str, str] = {}
    for w, m in words:
        if m and fold(w):
            seen.setdefault(fold(w), fold(w))
    return Query(" ".join(w for w, m in words if not m), tuple(seen.values()))


def quoted(part: str) -> str:
    """A pattern for the literal, whatever signs it holds."""
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in part)


def excluded(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether none of the parts is in text."""
    out = F.lit(True)
    for p in parts:
        out = out & ~F.contains(text, F.lit(p))
    return out


def shard_search(docs: DataFrame, phrase: str, key: list[str], exclude: tuple[str, ...] = (), folded_column: str = "folded", postings: DataFrame | None = None) -> DataFrame:
    """Rows whose folded text holds the phrase. With trigram postings: their intersection, then verification; without, or under three characters: a scan; under two: nothing."""
    if len(phrase) < 2:
        return docs.where(F.lit(False)).withColumn("at", F.lit(None).cast("int"))
    if postings is not None and len(phrase) >= 3:
        wanted = sorted({phrase[i : i + 3] for i in range(len(phrase) - 2)})
        hits = postings.where(F.col("gram").isin(wanted)).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")
        docs = docs.join(hits, key, "left_semi")
    return docs.where(F.contains(folded_column, F.lit(phrase)) & excluded(F.col(folded_column), exclude)).withColumn("at", F.instr(folded_column, phrase) - 1)


def phrase_search(words: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc_id, start): adjacent whole words, by joining positions on the rarest word's side first through one group."""
    index = F.create_map(*[x for i, w in enumerate(phrase) for x in (F.lit(f"{w}"), F.lit(i))]) if len(set(phrase)) == len(phrase) else None
    if index is not None:
        rows = words.where(F.col("word").isin(phrase)).select("doc_id", (F.col("pos") - index[F.col("word")]).alias("start"), "word")
    else:
        parts = [words.where(F.col("word") == w).select("doc_id", (F.col("pos") - i).alias("start"), F.lit(f"{i}").alias("word")) for i, w in enumerate(phrase)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
    return rows.groupBy("doc_id", "start").agg(F.count_distinct("word").alias("n")).where(F.col("n") == len(phrase)).drop("n")


def heading_search(words: DataFrame, tokens: list[str]) -> DataFrame:
    """(doc_id, start): the first token ends a word, the last begins one, inner ones are whole; a single one is anywhere in a word."""
    n = len(tokens)

    def fits(i: int) -> Column:
        w, t = F.col("word"), F.lit(tokens[i])
        return F.contains(w, t) if n == 1 else F.endswith(w, t) if i == 0 else F.startswith(w, t) if i == n - 1 else w == t

    hit = F.array_compact(F.array(*[F.when(fits(i), F.lit(i)) for i in range(n)]))
    rows = words.select("doc_id", "pos", F.explode(hit).alias("i")).select("doc_id", (F.col("pos") - F.col("i")).alias("start"), "i")
    return rows.groupBy("doc_id", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == n).drop("n")


def verse_ranking(verses: DataFrame, query: str, text: str = "text", marks: bool = False, fuzzy: bool = True, most: int = 1) -> DataFrame:
    """verses with score: exact 100, token prefix 92, substring 86, letters in order in a short verse 68, else 60 - 5 x
    distance (`most` at most) to a token. Each in the verse fold, with the small alef left out or read as alef; queries of
    one letter find nothing. query: in the verse fold."""
    if len(query) < 2:
        return verses.withColumn("score", F.lit(None).cast("int")).where(F.lit(False))
    q, most = F.lit(query), min(2, max(1, most))
    forms = verses.withColumn("_a", verse_fold(F.col(text), marks)).withColumn("_b", verse_fold(F.col(text), marks, True))
    a, b = F.col("_a"), F.col("_b")
    tokens = F.array_distinct(F.concat(F.split(a, " "), F.split(b, " ")))
    score = F.when((a == q) | (b == q), 100).when(F.exists(tokens, lambda t: F.startswith(t, q)), 92).when(F.contains(a, q) | F.contains(b, q), 86)
    if fuzzy and len(query) >= 3:
        letters = "(?s)" + ".*".join(quoted(c) for c in query)
        compact = [F.regexp_replace(c, r"(?U)\s", "") for c in (a, b)]
        score = score.when((F.least(F.length(a), F.length(b)) <= 2 * len(query) + 2) & (compact[0].rlike(letters) | compact[1].rlike(letters)), 68)
    if fuzzy and len(query) >= 4:
        near = F.array_min(F.transform(F.filter(tokens, lambda t: F.abs(F.length(t) - len(query)) <= most), lambda t: bounded_levenshtein(t, q, most)))
        score = score.when(near <= most, 60 - 5 * near)
    return forms.withColumn("score", score.cast("int")).where("score is not null").drop("_a", "_b")


def counted(hits: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of hits with the exact total; the limit stays within 0..500."""
    page = hits.orderBy(*order).offset(max(0, offset)).limit(max(0, min(500, limit)))
    return page.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row


def in_book(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, nth, start, end): all non-overlapping occurrences of a literal in the folded text."""
    pieces = docs.select("doc_id", F.split(folded(F.col("text")), quoted(part), -1).alias("p"))
    sizes = F.transform("p", lambda x: F.length(x))
    starts = pieces.where(F.size("p") > 1).select("doc_id", F.posexplode(F.slice(sizes, F.lit(1), F.size("p") - 1)).alias("nth", "gap"))
    w = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.sum("gap").over(w) + F.col("nth") * len(part)
    return starts.select("doc_id", "nth", at.alias("start"), (at + len(part)).alias("end"))


def occurrence_counts(docs: DataFrame, part: str) -> DataFrame:
    return docs.select("doc_id", occurrences(folded(F.col("text")), part).alias("n")).where("n > 0")


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """rows with the value of the greatest mark at or before them: one shuffle, no range join."""
    both = rows.withColumn(value, F.lit(None).cast(marks.schema[value].dataType)).withColumn("_mark", F.lit(1)).unionByName(marks.select(*by, at, value).withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, True).over(w)).where("_mark = 1").drop("_mark")


def routed_phrase(docs: DataFrame, words: DataFrame, phrase: str, folded_column: str = "folded") -> DataFrame:
    """Documents whose folded text holds the phrase: from four words on only those are read that have its two longest words."""
    asked = phrase.split(" ")
    held = F.contains(F.col(folded_column), F.lit(phrase))
    if len(asked) < 4:
        return docs.where(held)
    routes = sorted(dict.fromkeys(asked), key=len, reverse=True)[:2]
    both = words.where(F.col("word").isin(*routes)).groupBy("doc_id").agg(F.count_distinct("word").alias("n")).where(F.col("n") == len(routes))
    return docs.join(both.select("doc_id"), "doc_id", "left_semi").where(held)
