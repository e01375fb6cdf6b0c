"""License scans with a positional rare-token index.

The index holds licence texts word by word: for each word its inverse document frequency over all scanned
documents, and its postings, the places (template, position) where it stands. A file's licence words are
ranked by that frequency, and the rarest are looked up, with the rarest word of the key phrase of every
template whose key words the file has. A place in the file minus a posting's position is a start of that
template: words of one notice agree on it. Starts are encoded as numbers and sorted, and a start counts where
at least as many looked-up words agree as the key phrase has of them, which no whole key phrase can miss. There
the mandatory key phrase is verified word by word, and the score is the share of the template's IDF mass that
stands in place. Base phrases are templates that are all key phrase.

The index is data, one literal, so that expressions do not grow with templates. A document is examined by
position only if it has every word of some key phrase; that filter loses nothing, since key phrases are
mandatory. No Python touches a row: everything is array expressions.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise
from docloom.llm.license_texts import BASE, NOTICES

#: A word: digits, letters and everything beyond ASCII, after A-Z are lower-cased.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Least share of a notice's IDF mass in place; words of a file that are looked up beside those of its possible key phrases.
LEAST_COVER, RAREST = 0.5, 8

_TEMPLATES = "array<struct<id:int,label:string,base:boolean,shift:int,key:array<string>,need:array<string>,anchor:string,terms:array<struct<w:string,idf:double>>,mass:double>>"
_POSTINGS = "map<string,array<struct<id:int,at:int>>>"
_COVERS = "array<struct<label:string,cover:double,base:boolean>>"
#: A start's code is template * _STEP + start + _ZERO; starts before the file's first word are negative.
_STEP, _ZERO = 1 << 40, 1 << 20


def words_of(text: Column) -> Column:
    """The text's words. Only A-Z are lower-cased: of all other characters just the Kelvin sign and the
    dotted capital I become ASCII letters in lower case, so these two are replaced first, by another
    word character."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("é")), F.lit("\u0130"), F.lit("é"))
    return F.regexp_extract_all(F.lower(plain), F.lit(TOKEN), F.lit(0))


def templates_of(base: dict[str, str], notices: tuple[tuple[str, str, str], ...]) -> list[dict]:
    """Templates with their words, key phrase and the key's first place in the text."""
    out = []
    for label, text, key, is_base in [*((label, phrase, phrase, True) for phrase, label in base.items()), *((*n, False) for n in notices)]:
        text, key = text.split(), key.split()
        shift = next((i for i in range(len(text)) if text[i : i + len(key)] == key), None)
        if not key or shift is None:
            raise ValueError(f"the key phrase of a {label} template does not stand in its text")
        out.append({"id": len(out), "label": label, "base": is_base, "shift": shift, "key": key, "need": sorted(set(key)), "text": text})
    return out


def _weighed(templates: list[dict], idf: dict[str, float]) -> list[dict]:
    """Templates with the rarest word of their key phrase, and the IDF of every word."""
    out = []
    for t in templates:
        anchor = max(t["need"], key=lambda w: (idf[w], w))
        terms = [{"w": w, "idf": idf[w]} for w in t["text"]]
        out.append({**{k: t[k] for k in ("id", "label", "base", "shift", "key", "need")}, "anchor": anchor, "terms": terms, "mass": sum(idf[w] for w in t["text"])})
    return out


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def _has_all(words: Column, hits: Column) -> Column:
    return F.forall(words, lambda w: F.array_contains(hits, w))


def scan(
    docs: DataFrame,
    *,
    base: dict[str, str] = BASE,
    notices: tuple[tuple[str, str, str], ...] = NOTICES,
    least_cover: float = LEAST_COVER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, covers``.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are their smallest
    and largest start (null without one). ``labels`` adds the labels of the notices found, ``covers``
    has the best share of each (1 for base phrases), by label, ``score`` the largest of these, 0 without any.
    A notice is found where its whole key phrase stands and at least ``least_cover`` of its IDF mass is in
    place. A null text counts as empty. Repeated rows give repeated results; other columns are not looked at.
    Document frequencies are counted over all rows of ``docs``; an empty table gives an empty result.
    """
    templates = templates_of(base, notices)
    vocabulary = sorted({w for t in templates for w in t["text"]})
    needs = _literal([t["need"] for t in templates], "array<array<string>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("hits", F.array_intersect("words", F.lit(vocabulary)))
    candidate = F.exists(needs, lambda need: _has_all(need, F.col("hits")))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "hits", F.when(candidate, F.col("words")).alias("words"))
    rows = materialise(rows, "licence-words")
    total = rows.count()
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    idf = {w: 1 + math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}

    postings = defaultdict(list)
    for t in templates:
        for at, w in enumerate(t["text"]):
            postings[w].append({"id": t["id"], "at": at})
    by_rarity = _literal(sorted(vocabulary, key=lambda w: (-idf[w], w)), "array<string>")
    every = _literal(_weighed(templates, idf), _TEMPLATES)

    here = F.col("words").isNotNull()
    found = rows.withColumn("possible", F.when(here, F.filter(every, lambda t: _has_all(t["need"], F.col("hits")))))
    rarest = F.slice(F.filter(by_rarity, lambda w: F.array_contains("hits", w)), 1, RAREST)
    found = found.withColumn("lookup", F.when(here, F.array_union(rarest, F.transform("possible", lambda t: t["anchor"]))))
    # how many looked-up words every whole key phrase must bring
    least = F.map_from_entries(F.transform("possible", lambda t: F.struct(t["id"], F.size(F.filter(t["key"], lambda w: F.array_contains("lookup", w))))))
    found = found.withColumn("least", F.when(here, least))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda o: F.array_contains("lookup", o["w"]))
    codes = F.flatten(
        F.transform(
            places,
            lambda o: F.transform(
                F.filter(F.element_at(_literal(postings, _POSTINGS), o["w"]), lambda p: F.map_contains_key("least", p["id"])),
                lambda p: p["id"].cast("long") * _STEP + (o["i"] - p["at"] + _ZERO).cast("long"),
            ),
        )
    )
    found = found.withColumn("codes", F.when(here, F.sort_array(codes)))
    template_of = lambda c: F.floor(c / F.lit(_STEP)).cast("int")
    agreed = F.filter("codes", lambda c, i: ((i == 0) | (F.get("codes", i - 1) != c)) & (F.get("codes", i + F.element_at("least", template_of(c)) - 1) == c))
    found = found.withColumn("agreed", F.when(here, F.transform(agreed, lambda c: F.struct(template_of(c).alias("id"), (F.pmod(c, F.lit(_STEP)) - _ZERO).cast("int").alias("start")))))

    def stands(t: Column, start: Column) -> Column:
        at = start + t["shift"] + 1
        return F.when(at >= 1, F.slice("words", at, F.size(t["key"])) == t["key"]).otherwise(False)

    def cover(t: Column, start: Column) -> Column:
        inside = F.transform(t["terms"], lambda x, j: F.when(F.get("words", start + j).eqNullSafe(x["w"]), x["idf"]).otherwise(0.0))
        return F.least(F.lit(1.0), F.aggregate(inside, F.lit(0.0), lambda a, x: a + x) / t["mass"])

    def verified(t: Column) -> Column:
        starts = F.transform(F.filter("agreed", lambda a: (a["id"] == t["id"]) & stands(t, a["start"])), lambda a: a["start"])
        best = lambda s: F.when(t["base"], F.when(F.size(s) > 0, 1.0)).otherwise(F.array_max(F.transform(s, lambda x: cover(t, x))))
        return F.element_at(F.transform(F.array(starts), lambda s: F.struct(t["label"].alias("label"), best(s).alias("cover"), t["base"].alias("base"), s.alias("starts"))), 1)

    good = F.filter(F.transform("possible", verified), lambda v: F.when(v["base"], F.size(v["starts"]) > 0).otherwise(v["cover"] >= least_cover))
    found = found.withColumn("good", F.when(here, good))
    found = found.withColumn("starts", F.flatten(F.transform(F.filter("good", lambda v: v["base"]), lambda v: v["starts"])))
    named = lambda vs: F.array_sort(F.array_distinct(F.transform(vs, lambda v: v["label"])))
    joined = lambda vs: F.coalesce(F.array_join(named(vs), ","), F.lit(""))
    of_label = lambda label: F.filter("good", lambda v: v["label"] == label)
    covers = F.transform(named(F.col("good")), lambda x: F.struct(x.alias("label"), F.array_max(F.transform(of_label(x), lambda v: v["cover"])).alias("cover"), F.exists(of_label(x), lambda v: v["base"]).alias("base")))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.when(here, F.size("starts")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        joined(F.filter("good", lambda v: v["base"])).alias("base_labels"),
        joined(F.col("good")).alias("labels"),
        F.coalesce(F.array_max(F.transform("good", lambda v: v["cover"])), F.lit(0.0)).alias("score"),
        F.coalesce(covers, F.array().cast(_COVERS)).alias("covers"),
    )
