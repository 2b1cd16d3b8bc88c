"""What repeats in transcripts, across models: character spans on the timeline, words behind characters, shared hotspots, replacements.

Joins on places and times are equi-joins on bins, with the exact condition as a residue. A bin belongs to a recording, so that
a recording of any length is dealt over many tasks; a pair is given in one of the bins that both sides are in.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources.sinks import stored
from . import intervals as iv
from .kernels import repeats, word_numbers

#: What the reports call white space.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], width: float, a: tuple[str, str] = ("lo", "hi"), b: tuple[str, str] = ("start_sec", "end_sec")) -> DataFrame:
    """Pairs of left (keys, a) and right (keys, b) rows whose half-open spans share something, each once. Names other than the keys must differ.

    A span lies in every bin of `width` that it touches; a pair is given in the bin where the later of the two begins. Spans with a null or without length meet nothing.
    Both sides are sorted and merged: rows made by exploding look small to Spark, which would send them whole to the driver and to every task.
    """
    bin_of = lambda c: F.floor(c / F.lit(width))
    binned = lambda df, s: df.where(F.col(s[1]) > F.col(s[0])).withColumn("__bin", F.explode(F.sequence(bin_of(F.col(s[0])), bin_of(F.col(s[1])))))
    l, r = binned(left, a), binned(right, b).withColumnsRenamed({k: f"__{k}" for k in [*keys, "__bin"]})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__bin") == F.col("____bin")]
    on += [F.col(a[0]) < F.col(b[1]), F.col(b[0]) < F.col(a[1]), F.col("__bin") == bin_of(F.greatest(a[0], b[0]))]
    return l.hint("merge").join(r, on).drop("__bin", "____bin", *[f"__{k}" for k in keys])


# places in texts


def word_offsets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, nth, word, char_start, char_end: the words of a text between white space, in code points. Keys must tell rows apart; a null text has none."""
    parts = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))).alias("nth", "part"))
    end = F.sum(F.length("part")).over(Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    word = F.regexp_replace("part", f"^[{SPACE}]+", "")
    return parts.select(*keys, F.col("nth").cast("long").alias("nth"), word.alias("word"), (end - F.length(word)).alias("char_start"), end.alias("char_end"))


_WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))


@F.pandas_udf(_WORDS)
def _marked(texts: pd.Series) -> pd.Series:
    """Words that the next word of the text repeats, from the start of the first to the end of the second, and at the ends of the list the text's first and last word."""

    def one(text: str | None) -> list[tuple[str, int, int]]:
        w = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
        return [w[0], *((a[0], a[1], b[2]) for a, b in zip(w, w[1:], strict=False) if a[0] == b[0]), w[-1]] if w else []

    return texts.map(one)


def doubled_words(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, char_start, char_end: words said twice running in the text of all segments, in order of seg_idx, from the start of the first to the end of the second.

    Words meet inside their segment; only the first and the last of each segment go to a window, so that words aren't shuffled.
    """
    marked = segments.select(*keys, "seg_idx", F.length("text").alias("said"), _marked(F.col("text")).alias("w"))
    order = Window.partitionBy(*keys).orderBy("seg_idx")
    before = F.sum(F.coalesce("said", F.lit(0)) + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = marked.withColumn("char_lo", F.coalesce(before, F.lit(0)).cast("long")).where(F.size("w") > 0)
    first, last = F.get("w", F.lit(0)), F.element_at("w", -1)
    after = Window.partitionBy(*keys).orderBy("char_lo")
    placed = placed.withColumns({"next_word": F.lead(first["word"]).over(after), "next_hi": F.lead(F.col("char_lo") + first["hi"]).over(after)})
    inside = F.transform(F.slice("w", 2, F.size("w") - 2), lambda x: F.struct((F.col("char_lo") + x["lo"]).alias("char_start"), (F.col("char_lo") + x["hi"]).alias("char_end")))
    across = F.when(last["word"] == F.col("next_word"), F.array(F.struct((F.col("char_lo") + last["lo"]).alias("char_start"), F.col("next_hi").alias("char_end"))))
    spans = F.concat(inside, F.coalesce(across, F.slice(inside, 1, 0)))
    return placed.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.char_start", "s.char_end")


def segment_offsets(segments: DataFrame, keys: list[str], length: Column | None = None) -> DataFrame:
    """segments with char_lo and char_hi, their places in the text of all segments of the keys, in order of seg_idx, joined by line breaks."""
    said = F.coalesce(F.length("text") if length is None else length, F.lit(0))
    before = F.coalesce(F.sum(said + 1).over(Window.partitionBy(*keys).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("char_lo", before.cast("long")).withColumn("char_hi", F.col("char_lo") + said)


def time_spans(chars: DataFrame, segments: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """chars (keys, char_start, char_end, ...) -> with seg_idx, time_start and time_end of each part that lies in a segment.

    Time runs evenly over a segment's characters. Segments without text or time, and parts without length, give nothing.
    """
    s = segments.select(*keys, "seg_idx", "start_sec", "end_sec", F.length("text").alias("__said"))
    s = segment_offsets(s, keys, F.col("__said")).where("end_sec > start_sec").drop("__said")
    j = overlap_pairs(chars, s, keys, width, ("char_start", "char_end"), ("char_lo", "char_hi"))
    at = lambda c: F.col("start_sec") + (c - F.col("char_lo")) / (F.col("char_hi") - F.col("char_lo")) * (F.col("end_sec") - F.col("start_sec"))
    j = j.withColumns({"time_start": at(F.greatest("char_start", "char_lo")), "time_end": at(F.least("char_end", "char_hi"))})
    return j.where("time_end > time_start").drop("start_sec", "end_sec", "char_lo", "char_hi")


def sampled_places(start: Column, end: Column, about: int = 25) -> Column:
    """About 25 places of a span, evenly spaced from its start; all of a shorter one."""
    step = F.greatest(F.lit(1), F.floor((end - start) / F.lit(about)).cast("long"))
    return F.when(end > start, F.sequence(start, end - 1, step)).otherwise(F.array().cast("array<long>"))


def words_at(points: DataFrame, segments: DataFrame, words: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """points (keys, char_pos, ...) -> with the (seg_idx, word_idx) of words (keys, seg_idx, word_idx, word) that stands there.

    A word stands where its text is first found in its segment. Of several the first counts, and where none covers the place, the first of the segment. Places
    outside of segments, and those in segments without words, drop out.
    """
    s = segment_offsets(segments.select(*keys, "seg_idx", "text"), keys)
    # segments that no point lies in have nothing to give: neither their texts nor their words go on
    at = points.select(*keys, "char_pos", (F.col("char_pos") + 1).alias("char_next"))
    bounds = segment_offsets(segments.select(*keys, "seg_idx", F.length("text").alias("said")), keys, F.col("said"))
    met = overlap_pairs(at, bounds.select(*keys, "seg_idx", "char_lo", "char_hi"), keys, width, ("char_pos", "char_next"), ("char_lo", "char_hi"))
    met = stored(met.select(*keys, "seg_idx").distinct())
    names = {k: f"m_{k}" for k in [*keys, "seg_idx"]}
    some = lambda df: df.join(met.withColumnsRenamed(names), [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()], "left_semi")
    s, words = some(s), some(words.select(*keys, "seg_idx", "word_idx", "word"))
    names = {k: f"s_{k}" for k in [*keys, "seg_idx"]}
    of = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    w = words.hint("merge").join(s.withColumnsRenamed(names), of).drop(*names.values())
    found = F.expr("position(word, text)") - 1
    w = w.withColumns({"w_lo": F.when(found >= 0, F.col("char_lo") + found), "first_word": F.min("word_idx").over(Window.partitionBy(*keys, "seg_idx"))})
    w = w.withColumn("w_hi", F.col("w_lo") + F.length("word"))
    p = points.withColumn("__id", F.monotonically_increasing_id()).withColumn("char_next", F.col("char_pos") + 1)
    # every segment with words meets its points; the words that cover a point come with it
    firsts = w.where("word_idx = first_word").select(*keys, "seg_idx", "first_word", "char_lo", "char_hi")
    met = overlap_pairs(p, firsts, keys, width, ("char_pos", "char_next"), ("char_lo", "char_hi")).drop("char_lo", "char_hi")
    ranges = w.where("w_lo IS NOT NULL").select(*keys, F.col("seg_idx").alias("w_seg"), "word_idx", "w_lo", "w_hi")
    covering = overlap_pairs(p.select(*keys, F.col("__id").alias("w_id"), "char_pos", "char_next"), ranges, keys, width, ("char_pos", "char_next"), ("w_lo", "w_hi"))
    covering = covering.groupBy("w_id", "w_seg").agg(F.min("word_idx").alias("covering"))
    out = met.join(covering, (F.col("__id") == F.col("w_id")) & (F.col("seg_idx") == F.col("w_seg")), "left")
    return out.withColumn("word_idx", F.coalesce("covering", "first_word")).drop("__id", "w_id", "w_seg", "covering", "first_word", "char_next")


def span_confidences(spans: DataFrame, segments: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, char_start, char_end) -> with n, mean, least, most of the confidences (of words) sampled over each; spans without any drop out."""
    points = spans.select(*keys, "char_start", "char_end", F.explode(sampled_places(F.col("char_start"), F.col("char_end"))).alias("char_pos"))
    at = words_at(points, segments, words, keys)
    sure = words.select(*[F.col(k).alias(f"c_{k}") for k in [*keys, "seg_idx", "word_idx"]], "confidence").where("confidence IS NOT NULL")
    j = at.join(sure, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in [*keys, "seg_idx", "word_idx"]])
    c = F.col("confidence")
    return j.groupBy(*keys, "char_start", "char_end").agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))


def confidence_difference(sampled: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, spans, repeated (mean over spans of their means), baseline (mean of all words), difference."""
    every = words.where("confidence IS NOT NULL").groupBy(*keys).agg(F.avg("confidence").alias("baseline"))
    found = sampled.groupBy(*keys).agg(F.count("*").alias("spans"), F.avg("mean").alias("repeated"))
    return found.join(every, keys).withColumn("difference", F.col("repeated") - F.col("baseline"))


# hotspots of several models


def repeated_spans(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_sec, end_sec: where neighbouring segments (by start, end, seg_idx) of the keys say the same, merged within a millisecond."""
    said = F.lower(F.trim("text"))
    order = Window.partitionBy(*keys).orderBy("start_sec", "end_sec", "seg_idx")
    rows = segments.where("end_sec > start_sec").withColumns({"said": said, "next_said": F.lead(said).over(order), "next_end": F.lead("end_sec").over(order)})
    rows = rows.where("said <> '' AND said = next_said").select(*keys, "start_sec", F.col("next_end").alias("end_sec"))
    return iv.union(rows, keys, tolerance=1e-3, drop_empty=False).drop("n_merged")


def near_matches(spans: DataFrame, keys: list[str], tolerance: float = 0.75, ratio: float = 3.0, width: float = 30.0) -> DataFrame:
    """spans (keys, model_key, start_sec, end_sec) -> events (keys, model_a, model_b, lo, hi) of two models, a < b.

    Two spans make an event where they overlap (what they share), or where their centres are at most `tolerance` seconds apart and the
    longer is at most `ratio` times the shorter (both, widened by the tolerance). The second kind is joined on bins of centre and of log length,
    one side sent to the bins beside as well.
    """
    side = lambda x: spans.select(*keys, F.col("model_key").alias(f"model_{x}"), F.col("start_sec").alias(f"s_{x}"), F.col("end_sec").alias(f"e_{x}"))
    a, b = side("a"), side("b")
    both = overlap_pairs(a, b, keys, width, ("s_a", "e_a"), ("s_b", "e_b")).where("model_a < model_b")
    shared = both.select(*keys, "model_a", "model_b", F.greatest("s_a", "s_b").alias("lo"), F.least("e_a", "e_b").alias("hi"))

    def binned(df: DataFrame, x: str, near: tuple[int, ...]) -> DataFrame:
        s, e = F.col(f"s_{x}"), F.col(f"e_{x}")
        length = F.greatest(e - s, F.lit(1e-6))
        beside = F.array(*[F.lit(k) for k in near])
        # a little wider than the bounds, so that rounding loses none
        df = df.withColumns({f"c_{x}": (s + e) / 2, f"l_{x}": e - s})
        df = df.withColumn(f"t_{x}", F.explode(F.transform(beside, lambda k: F.floor(F.col(f"c_{x}") / (tolerance * 1.001)) + k)))
        return df.withColumn(f"d_{x}", F.explode(F.transform(beside, lambda k: F.floor(F.log(length) / (math.log(ratio) * 1.001)) + k)))

    l, r = binned(a, "a", (0,)), binned(b, "b", (-1, 0, 1)).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("t_a") == F.col("t_b"), F.col("d_a") == F.col("d_b"), F.col("model_a") < F.col("model_b")]
    apart = F.least("e_a", "e_b") <= F.greatest("s_a", "s_b")
    la, lb = F.greatest("l_a", F.lit(0.0)), F.greatest("l_b", F.lit(0.0))
    alike = (F.abs(F.col("c_a") - F.col("c_b")) <= tolerance) & (F.greatest(la, lb) / F.greatest(F.least(la, lb), F.lit(1e-6)) <= ratio)
    lo, hi = F.greatest("s_a", "s_b") - tolerance, F.least("e_a", "e_b") + tolerance
    close = l.join(r, on).where(apart & alike)
    close = close.select(*keys, "model_a", "model_b", F.when(hi > lo, lo).otherwise(F.least("s_a", "s_b")).alias("lo"), F.when(hi > lo, hi).otherwise(F.greatest("e_a", "e_b")).alias("hi"))
    return shared.unionByName(close).where("hi > lo")


def hotspots(events: DataFrame, keys: list[str], tolerance: float = 0.75, min_models: int = 2) -> DataFrame:
    """Events (keys, model_a, model_b, lo, hi) closer than the tolerance as windows: keys, start_time, end_time, duration, models, model_count, pair_matches, nth (1 is the foremost: most models, then longest, then most pairs)."""
    e = events.select(*keys, F.col("lo").alias("start_sec"), F.col("hi").alias("end_sec"), F.array("model_a", "model_b").alias("models"))
    w = iv.windows_of_models(e, keys, tolerance, min_models).withColumn("model_count", F.size("models").cast("long"))
    w = w.select(*keys, F.round("start_sec", 3).alias("start_time"), F.round("end_sec", 3).alias("end_time"), F.round(F.col("end_sec") - F.col("start_sec"), 3).alias("duration"), "models", "model_count", F.col("n_events").alias("pair_matches"))
    order = Window.partitionBy(*keys).orderBy(F.desc("model_count"), F.desc("duration"), F.desc("pair_matches"), "start_time")
    return w.withColumn("nth", F.row_number().over(order).cast("long"))


def hotspot_summary(found: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row: recordings with spans of two models or more, how many of them have hotspots, hotspots, and those that all models of the recording with spans share."""
    models = spans.groupBy(*keys).agg(F.countDistinct("model_key").alias("with_spans")).where("with_spans >= 2")
    j = models.join(found, keys, "left")
    return j.groupBy(*keys).agg(F.count("nth").alias("n"), F.count(F.when(F.col("model_count") == F.col("with_spans"), 1)).alias("every")).agg(
        F.count("*").alias("compared"), F.count(F.when(F.col("n") > 0, 1)).alias("with_hotspots"), F.coalesce(F.sum("n"), F.lit(0)).alias("hotspots"), F.coalesce(F.sum("every"), F.lit(0)).alias("all_models")
    )


def texts_of_spans(spans: DataFrame, segments: DataFrame, keys: list[str], width: float = 30.0) -> DataFrame:
    """spans (keys, lo, hi) with, for each model with text there, model_key, said (trimmed texts of the segments met, in order, by blanks) and ratio (share of the span that segments cover, overlaps twice, at most 1)."""
    s = segments.select(*keys, "model_key", "seg_idx", "start_sec", "end_sec", "text").where("end_sec > start_sec")
    j = overlap_pairs(spans, s, keys, width)
    own = [c for c in spans.columns if c not in ("lo", "hi")]
    part = F.least("hi", "end_sec") - F.greatest("lo", "start_sec")
    said = F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("start_sec", "end_sec", "seg_idx", F.trim("text").alias("t")))))  # the segments of one span
    out = j.groupBy(*own, "lo", "hi", "model_key").agg(F.array_join(said["t"], " ").alias("said"), F.least(F.lit(1.0), F.sum(part) / F.first(F.col("hi") - F.col("lo"))).alias("ratio"))
    return out.where("said <> ''")


def short(text: Column, most: int = 180) -> Column:
    """The text with blanks in place of any white space, cut to `most` characters, the last of them a mark."""
    compact = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.when(F.length(compact) > most, F.concat(F.rtrim(F.substring(compact, 1, most - 1)), F.lit("…"))).otherwise(compact)


def hotspot_texts(found: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model_key, snippet: what each model of the foremost hotspot of a recording says there."""
    top = found.where("nth = 1").select(*keys, F.col("start_time").alias("lo"), F.col("end_time").alias("hi"), "models")
    return texts_of_spans(top, segments, keys).where(F.array_contains("models", F.col("model_key"))).select(*keys, "model_key", short(F.col("said")).alias("snippet"))


# replacements


@F.pandas_udf(T.DoubleType())
def repetition_score(texts: pd.Series) -> pd.Series:
    """The sum of times * length over repeated blocks of one to eight words; a word's case, form and edge marks don't count, blocks with a word of marks alone count nothing."""

    def score(text: str | None) -> float:
        items = word_numbers(text or "")
        if len(set(items.tolist())) == len(items):  # no word stands there twice
            return 0.0
        marks = np.r_[0, np.cumsum(items < 0)]
        return float(sum(times * size for size in range(1, 9) for start, times in repeats(items, size) if marks[start + size] == marks[start]))

    return texts.map(score)


def quality(ratio: Column, agreement: Column, improvement: Column) -> Column:
    """How good a replacement is: how much of the span it covers, how far the other models agree, how much repetition it takes away."""
    return 0.6 * ratio + 0.3 * agreement + 0.1 * F.greatest(F.lit(0.0), F.least(improvement / 10.0, F.lit(1.0)))  # fixed values


def sureness(quality: Column, improvement: Column, ratio: Column) -> Column:
    return F.when((quality >= 0.8) & (improvement >= 2) & (ratio >= 0.8), "high").when((quality >= 0.6) & (ratio >= 0.6), "medium").otherwise("low")  # fixed values


def patch_candidates(segments: DataFrame, keys: list[str], min_overlap: float = 0.5, min_models: int = 2) -> DataFrame:
    """Replacements of repeated spans of one model by what another says there, best first within a span.

    segments (keys, model_key, seg_idx, start_sec, end_sec, text) -> keys, source_model, lo, hi, source_text, model_key, said, ratio, agreement, source_score, score,
    improvement, quality, confidence, nth: the best (nth 1) and the next two. Of equal quality the model whose name comes first. A span without repeated words, one whose
    best candidate repeats as much, and recordings of fewer models have none. agreement is the mean likeness to the other models' texts, one half where there are none.
    """
    usable = segments.where("end_sec > start_sec")
    enough = usable.groupBy(*keys).agg(F.countDistinct("model_key").alias("__models")).where(F.col("__models") >= min_models).drop("__models")
    usable = usable.join(enough, keys, "left_semi")
    spans = repeated_spans(usable, [*keys, "model_key"]).select(*keys, F.col("model_key").alias("source_model"), F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    told = stored(texts_of_spans(spans, usable, keys).withColumn("score", repetition_score("said")))  # read three times below
    span = [*keys, "source_model", "lo", "hi"]
    source = told.where("model_key = source_model AND score > 0").select(*span, F.col("said").alias("source_text"), F.col("score").alias("source_score"))
    others = told.where("model_key <> source_model").join(source, span)
    able = others.where(F.col("ratio") >= min_overlap)
    # each candidate beside each other text of its span: pairs of models, of which there are few
    beside = others.select(*[F.col(c).alias(f"o_{c}") for c in span], F.col("model_key").alias("o_model"), F.col("said").alias("o_said"))
    pairs = able.join(beside, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in span]).where("model_key <> o_model")
    agreed = pairs.select(*span, "model_key", tx.similarity("said", "o_said").alias("alike")).groupBy(*span, "model_key").agg(F.avg("alike").alias("agreement"))
    rows = able.join(agreed, [*span, "model_key"], "left").withColumns({"agreement": F.coalesce("agreement", F.lit(0.5)), "improvement": F.col("source_score") - F.col("score")})
    rows = rows.withColumn("quality", F.round(quality(F.col("ratio"), F.col("agreement"), F.col("improvement")), 4))
    of_span = Window.partitionBy(*span).orderBy(F.desc("quality"), "model_key")
    rows = rows.withColumns({"nth": F.row_number().over(of_span).cast("long"), "best": F.first("improvement").over(of_span)}).where("nth <= 3 AND best > 0").drop("best")
    return rows.withColumn("confidence", sureness(F.col("quality"), F.col("improvement"), F.round("ratio", 4)))
