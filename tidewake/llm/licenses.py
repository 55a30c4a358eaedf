"""Licence scan: notices and licence files against templates, and inheritance down directories.

The project keeps no source files, so the operators are general: records are any table with an id, a path and a text.

Everything on the main path is DataFrame functions. A line is a sparse TF-IDF vector; its cosine to each template says
which licence it names. So are windows of words, wherever lines end, to headers and versioned names, and whole records to
full texts (`license_templates`). Weights come from the lines of the whole table. A record without a notice of its own
inherits that of the nearest directory above it which holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from .license_templates import Passage, passages as known_passages

# fixed values: short notices by licence
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0 Creative Commons Attribution",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
WORD = "[a-z0-9]+"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
MAX_TEMPLATE_WORDS = 10_000
THRESHOLD = 0.6


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _lines(records: DataFrame, *keep: str) -> DataFrame:
    """One row for each line with words."""
    lines = records.select(*keep, F.posexplode(F.split(F.lower("body"), "\n")).alias("line", "content"))
    return lines.select(*keep, "line", F.regexp_extract_all("content", F.lit(f"({WORD})"), F.lit(1)).alias("words")).where(F.size("words") > 0)


def _weights(records: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency, over all lines, of the template words, and that of a word seen in no line, which all
    other words get. Only one number for each template word reaches the driver."""
    spark = records.sparkSession
    terms = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    words = _lines(records).select(F.explode(F.array_distinct("words")).alias("word"))
    seen = {r.word: r.n for r in words.join(terms, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = records.agg(F.sum(F.size(F.split("body", "\n")).cast("long"))).first()[0] or 0
    weight = {w: math.log((1 + total) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}
    return weight, math.log(1 + total) + 1


def _needed(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words of which a line must hold at least one to reach the threshold with any template. The rest of a template's
    words is too light: by Cauchy-Schwarz a cosine is at most the norm of the shared part over that of the template."""
    needed: set[str] = set()
    for vector in vectors.values():
        left, total = 0.0, sum(w * w for w in vector.values())
        for word, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            left += w * w
            if left >= threshold * threshold * total * (1 - 1e-9):
                needed.add(word)
    return sorted(needed)


def _passage_scores(base: DataFrame, passages: list[Passage], weight: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """Record, path, name and score of all windows and whole records that hold the keys of a passage and reach the threshold.

    A window has as many words as its passage and lies so that the passage's first key is in its place; words are counted
    from the start of the record, so lines may end anywhere. A whole record has half to twice the words of a full text;
    there a word that occurs n times counts 1 + ln n.
    """
    spark = base.sparkSession
    listed = [(k, p, _words(p.text)) for k, p in enumerate(passages)]
    anchors = sorted({p.keys[0] for p in passages if not p.whole})
    reach = max((len(words) for _, p, words in listed if not p.whole), default=1)
    sizes = [len(words) for _, p, words in listed if p.whole]
    places, entries = [], []
    for k, p, words in listed:
        at = [None] if p.whole else [i for i, w in enumerate(words) if w == p.keys[0]]
        places += [("" if p.whole else p.keys[0], k, i, len(words), list(p.keys)) for i in at]
        shares = {w: (1 + math.log(n) if p.whole else n) * weight[w] for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in shares.values()))
        entries += [(k, p.name, w, x / norm) for w, x in shares.items()]
    firsts = sorted({p.keys[0] for p in passages})
    trigger = "(?<![a-z0-9])(?:" + "|".join(firsts) + ")(?![a-z0-9])" if firsts else "(?!)"
    body = F.lower("body")
    texts = base.where(body.rlike(trigger)).select("record", "path", F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    held = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains(F.array(*[F.lit(a) for a in anchors] or [F.lit("")]), F.element_at("words", i)))
    around = F.transform(held, lambda i: F.struct(
        F.element_at("words", i).alias("anchor"), F.slice("words", F.greatest(F.lit(1), i - reach), F.least(F.lit(reach), i - 1)).alias("before"),
        F.slice("words", i + 1, F.lit(reach)).alias("after")))
    none = F.array().cast("array<string>")
    fits = F.size("words").between(math.ceil(min(sizes, default=0) / 2), 2 * max(sizes, default=-1))
    whole = F.when(fits, F.array(F.struct(F.lit("").alias("anchor"), F.col("words").alias("before"), none.alias("after")))).otherwise(
        F.array().cast("array<struct<anchor:string,before:array<string>,after:array<string>>>"))
    units = texts.where(F.size("words") > 0).select("record", "path", F.explode(F.concat(around, whole)).alias("u")).select("record", "path", "u.*")
    table = F.broadcast(spark.createDataFrame(places, "anchor string, passage int, place int, n int, keys array<string>"))
    left = F.least("place", F.size("before"))
    window = F.when(F.col("anchor") == "", F.col("before")).otherwise(F.concat(
        F.slice("before", F.size("before") - left + 1, left), F.array("anchor"), F.slice("after", F.lit(1), F.col("n") - 1 - F.col("place"))))
    found = units.join(table, "anchor").where((F.col("anchor") != "") | F.size("before").between(F.ceil(F.col("n") / 2), 2 * F.col("n"))).select(
        "record", "path", "passage", "keys", window.alias("words")).where(F.size(F.array_except("keys", "words")) == 0)
    # equal windows are weighed once
    found = found.select("record", "path", "passage", "words", F.sha2(F.array_join("words", " "), 256).alias("key"))
    tf = found.groupBy("passage", "key").agg(F.first("words").alias("words")).select("passage", "key", F.explode("words").alias("word")).groupBy(
        "passage", "key", "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.broadcast(spark.createDataFrame(list(weight.items()), "word string, idf double"))
    long = [k for k, p, _ in listed if p.whole]
    count = F.when(F.col("passage").isin(long), 1 + F.log(F.col("tf").cast("double"))).otherwise(F.col("tf"))
    weighed = tf.join(idf, "word", "left").withColumn("w", count * F.coalesce("idf", F.lit(unseen)))
    shares = F.broadcast(spark.createDataFrame(entries, "passage int, name string, word string, share double"))
    scored = weighed.join(shares, ["passage", "word"], "left").groupBy("passage", "key").agg(
        F.max("name").alias("name"), F.round(F.sum(F.col("w") * F.col("share")) / F.sqrt(F.sum(F.col("w") * F.col("w"))), 9).alias("score"))
    return found.select("record", "path", "passage", "key").join(scored.where(F.col("score") >= threshold), ["passage", "key"]).select(
        "record", "path", "name", "score")


def scan(records: DataFrame, record_id: str = "doc_id", path: str = "path", text: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD, license_file: str = LICENSE_FILE, passages: list[Passage] | None = None) -> DataFrame:
    """Licence of every record: its own notice's, or that inherited from the nearest directory above.

    templates: licence name to notice, compared with single lines. passages: headers, headings and names, compared with
    windows of words, and full texts, compared with whole records; those of `license_templates` if there are no templates of
    the caller's, else none. Both have at most MAX_TEMPLATE_WORDS different words. A line, window or record matches the
    template of the highest cosine at or over `threshold`; a record has the licence of its best match, ties to the least
    name. A line's template has no key words: a version that no passage names goes to its nearest line. license_file: pattern of paths whose record speaks for its directory; if several do, the best score, then the
    least name holds. Scores are rounded to 9 digits before they are compared.

    Returns record_id, path, license, score, inherited_from (a directory; null for an own notice, or none). Null and empty
    texts have no notice; null paths inherit nothing. Rows of equal id and path are one record, with the best of their
    matches. Whole texts are read. An empty table gives no rows. Other columns are left out.
    """
    passages = passages if passages is not None else known_passages() if templates is None else []
    templates = TEMPLATES if templates is None else templates
    counts = {name: Counter(_words(notice)) for name, notice in templates.items()}
    vocabulary = sorted({w for c in counts.values() for w in c})
    wide = sorted({w for p in passages for w in _words(p.text)}.union(vocabulary))
    if len(wide) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words")
    base = records.select(F.col(record_id).alias("record"), F.col(path).cast("string").alias("path"),
                          F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    every, unseen = _weights(base, wide)
    weight = {w: every[w] for w in vocabulary}
    vectors = {name: {w: n * weight[w] for w, n in c.items()} for name, c in counts.items()}
    norms = {name: math.sqrt(sum(x * x for x in v.values())) for name, v in vectors.items()}
    spark = records.sparkSession
    needed = _needed(vectors, threshold)
    rows = [(w, name, vectors[name][w] / norms[name]) for name in templates for w in counts[name]]
    entries = F.broadcast(spark.createDataFrame(rows, "word string, name string, share double"))
    idf = F.broadcast(spark.createDataFrame(list(weight.items()), "word string, idf double"))

    trigger = "(?i)(" + "|".join(re.escape(w) for w in needed) + ")" if needed else "(?!)"
    lines = _lines(base.where(F.col("body").rlike(trigger)), "record", "path").where(
        F.arrays_overlap("words", F.array(*[F.lit(w) for w in needed] or [F.lit("")])))
    # equal lines are weighed once; a line is named by a digest while its words are apart
    lines = lines.select("record", "path", "words", F.sha2(F.array_join("words", " "), 256).alias("key"))
    counted = lines.groupBy("key").agg(F.first("words").alias("words")).select("key", F.explode("words").alias("word")).groupBy("key", "word").agg(
        F.count(F.lit(1)).alias("tf"))
    weighed = counted.join(idf, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(entries, "word").groupBy("key", "name").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    scored = dots.join(norm, "key").select("key", "name", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    by_line = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("m"))
    matched = lines.select("record", "path", "key").join(by_line, "key").select("record", "path", "m")
    if passages:
        longer = _passage_scores(base, passages, every, unseen, threshold)
        matched = matched.unionByName(longer.select("record", "path", F.struct((-F.col("score")).alias("minus"), "name").alias("m")))
    own = matched.groupBy("record", "path").agg(F.min("m").alias("m")).select(
        F.col("record").alias("record_"), F.col("path").alias("path_"), F.col("m.name").alias("own"), (-F.col("m.minus")).alias("own_score"))
    same = F.col("record").eqNullSafe(F.col("record_")) & F.col("path").eqNullSafe(F.col("path_"))

    found = base.select("record", "path").distinct().join(own, same, "left").select("record", "path", "own", "own_score")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    above = found.where(F.col("own").isNotNull() & F.col("path").rlike(license_file)).groupBy(parent.alias("dir")).agg(
        F.min(F.struct((-F.col("own_score")).alias("minus"), F.col("own").alias("name"))).alias("m"))
    steps = F.split(parent, "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("dir")))
    wanting = found.where(F.col("own").isNull() & F.col("path").isNotNull()).select("record", "path", F.explode(ancestors).alias("a"))
    inherited = wanting.select("record", "path", "a.depth", "a.dir").join(above, "dir").groupBy("record", "path").agg(
        F.max(F.struct("depth", "dir", "m")).alias("best")).select(F.col("record").alias("record_"), F.col("path").alias("path_"), "best")
    return found.join(inherited, same, "left").select(
        F.col("record").alias(record_id), F.col("path").alias(path), F.coalesce("own", F.col("best.m.name")).alias("license"),
        F.coalesce("own_score", -F.col("best.m.minus")).alias("score"), F.when(F.col("own").isNull(), F.col("best.dir")).alias("inherited_from"))
