"""Licence scan by a positional rare-token index, in DataFrame functions only.

Templates are short licence texts. Their words, but for the stop words, are licence
words; each has postings: the templates and offsets where it stands. A file looks up
its licence words with the highest inverse document frequency (over all files scanned),
all their places are shifted by the postings' offsets to where a template would have to
start, and the postings are intersected: a start is a candidate if two of the words that
were looked up, or more, agree on it. A candidate stands if its key phrase is there, of
which one word may differ ("licence" for "license"), but none of its digits and not its
rarest word, as these tell licences apart.

A short quotation may have one rare word only. So the rarest word of each key phrase is
looked up whatever its rank, and where a key phrase stands word for word its template is
found with no word to agree. Base phrases are templates that are their own key phrase,
and have no other word than theirs, so each of their places is found, and nothing else.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKED_UP = 8
SPAN, SHIFT = 1 << 32, 1 << 10  # of a candidate: room for its start, which may be below zero

# Base phrases with their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Label, template, key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl-2.0", "subject to the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
]

# Words of templates that are never looked up.
STOP = "0 1 2 3 4 a all and any are by for in into is of or the this to under use v with without".split()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the ASCII-lower-cased text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAP), "")


#: Words of a key phrase that has enough others to be told by, if one of them differs.
LONG_KEY = 4


def collection(base=BASE, templates=TEMPLATES) -> list[dict]:
    out = []
    for is_base, rows in ((True, [(label, p, p) for label, p in base]), (False, templates)):
        for label, text, key in rows:
            w, k = text.split(), key.split()
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            out.append({"label": label, "base": is_base, "words": w, "key": k, "key_at": at})
    return out


def document_frequency(rows: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows in all, and of each licence word the rows that have it; ``rows`` has ``words``."""
    found = rows.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", F.array(*map(F.lit, vocabulary))))).alias("w"))
    counts = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}  # a row for each licence word
    return counts.pop("", 0), counts


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def must(template: dict, rank: dict[str, int]) -> list[int]:
    """Places in its key phrase of the words that tell it from other licences: digits, and the rarest."""
    key = template["key"]
    rarest = min((k for k, w in enumerate(key) if w in rank), key=lambda k: rank[key[k]])
    return sorted({rarest, *(k for k, w in enumerate(key) if w.isdigit())})


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", base=BASE, templates=TEMPLATES, looked_up: int = LOOKED_UP) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` of every row.

    ``matches`` lists each place: label, start (in words from 0; below 0 where the file
    begins within the template), coverage (the share of the
    template's weight whose words stand in place) and if it is a base phrase.
    ``score`` is the best coverage, 0 without a match. A null text counts as empty;
    a file without licence words has no match, null places and empty labels; ids may be
    null or repeat; other columns aren't read; no rows give no rows. Places that tie
    are each listed, by start and label. Time and memory are linear in a text's words,
    with a factor of the postings of its licence words.
    """
    all_templates = collection(base, templates)
    vocabulary = sorted({w for t in all_templates for w in t["words"]} - set(STOP))
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text)).alias("words"))
    total, df = document_frequency(rows, vocabulary)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1 for w in {w for t in all_templates for w in t["words"]}}
    rank = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}
    postings: dict[str, list] = {w: [] for w in vocabulary}
    table = []
    for n, t in enumerate(all_templates):
        rare = [k for k, w in enumerate(t["words"]) if w in rank]
        for k in rare:
            postings[t["words"][k]].append({"t": n, "at": k})
        weight = [idf[w] if w in rank else 1.0 for w in t["words"]]
        parts = [{"at": k, "word": w, "weight": weight[k] / sum(weight)} for k, w in enumerate(t["words"])]
        table.append({"label": t["label"], "base": t["base"], "parts": parts, "size": len(t["words"]), "first": t["key"][0], "key": " ".join(t["key"]), "key_at": t["key_at"], "key_size": len(t["key"]), "must": must(t, rank)})
    always = sorted({min((w for w in t["key"] if w in rank), key=rank.get) for t in all_templates})

    part = "array<struct<at:int,word:string,weight:double>>"
    templates_ = _literal(table, f"array<struct<label:string,base:boolean,parts:{part},size:int,first:string,key:string,key_at:int,key_size:int,must:array<int>>>")
    postings_ = _literal(postings, "map<string,array<struct<t:int,at:int>>>")
    ranks_ = _literal(rank, "map<string,int>")
    by_rank = F.array_sort(F.transform(F.array_intersect("words", F.array(*map(F.lit, vocabulary))), lambda w: F.struct(ranks_[w].alias("rank"), w.alias("word"))))
    best = F.transform(F.slice(by_rank, 1, looked_up), lambda x: x["word"])
    looked = F.array_union(best, F.array_intersect(F.transform(by_rank, lambda x: x["word"]), F.array(*map(F.lit, always))))
    found = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("best", best).withColumn("looked", looked)
    places = F.when(F.size("looked") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("looked", F.get("words", i)))).otherwise(F.array().cast("array<int>"))
    found = found.withColumn("places", places)
    looked_places, best_places = F.col("places"), F.filter("places", lambda i: F.array_contains("best", F.get("words", i)))

    def shifted(at: Column, postings: Column) -> Column:
        """Where templates would start, of places of words: one for each posting."""
        return F.flatten(F.transform(at, lambda i: F.transform(postings[F.get("words", i)], lambda p: p["t"].cast("long") * SPAN + (i - p["at"] + SHIFT))))

    # a candidate is one long, its template above its start: arrays of longs are made distinct by hashing
    found = found.withColumn("starts", F.array_distinct(shifted(looked_places, postings_)))
    # of the words that were looked up for their rank, each start as often as words agree on it
    agreeing = F.sort_array(shifted(best_places, postings_))
    found = found.withColumn("agreeing", agreeing).withColumn("agreed", F.array_distinct(F.filter("agreeing", lambda c, i: c == F.get("agreeing", i + 1))))

    def template(c: Column) -> Column:
        return F.get(templates_, (c / SPAN).cast("int"))

    def start(c: Column) -> Column:
        return (c % SPAN).cast("int") - SHIFT

    def key_stands(c: Column) -> Column:
        t, key_from = template(c), start(c) + template(c)["key_at"]
        first = F.get("words", F.when(key_from >= 0, key_from)) == t["first"]  # most candidates end here
        return F.when(first, F.array_join(F.slice("words", key_from + 1, t["key_size"]), " ") == t["key"]).otherwise(F.lit(False))

    def key_nearly_stands(c: Column) -> Column:
        t = template(c)
        stands = lambda p: F.get("words", F.when(start(c) + p["at"] >= 0, start(c) + p["at"])) == p["word"]
        key = F.slice(t["parts"], t["key_at"] + 1, t["key_size"])
        musts = F.forall(t["must"], lambda k: F.coalesce(stands(F.get(key, k)), F.lit(False)))
        return ~t["base"] & (t["key_size"] >= LONG_KEY) & (F.size(F.filter(key, stands)) == t["key_size"] - 1) & musts

    def judged(c: Column) -> Column:
        t = template(c)
        stands = F.filter(t["parts"], lambda p: F.get("words", F.when(start(c) + p["at"] >= 0, start(c) + p["at"])) == p["word"])
        coverage = F.aggregate(stands, F.lit(0.0), lambda a, p: a + p["weight"])
        return F.struct(t["label"].alias("label"), start(c).cast("long").alias("start"), F.least(F.round(coverage, 9), F.lit(1.0)).alias("coverage"), t["base"].alias("base"))

    found = found.withColumn("matches", F.transform(F.concat(F.filter("starts", key_stands), F.filter("agreed", key_nearly_stands)), judged))
    found = found.select("id", "n_words", F.array_sort(F.transform("matches", lambda m: F.struct(m["start"], m["label"], m["coverage"], m["base"]))).alias("matches"))
    base_ = found.withColumn("base", F.filter("matches", lambda m: m["base"]))
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    return base_.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        label("base").alias("base_labels"),
        label("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
        "matches",
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
