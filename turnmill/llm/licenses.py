r"""License scans by ordered signature rules, with SQL functions only and no shuffle.

Texts that hold a rule's keyword are normalised to words; rules whose keyword
occurs are run over them as regexes, and each detection is an interval of
words. A detection goes if another of higher priority covers its interval, or a
longer one of the same priority; ties keep the earlier rule. Base phrases
are counted wherever they stand and their labels always stay.

Words: A-Z lower-cased, runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`. Cases: a null
or wordless text has no words, no labels and score 0; equal rows are judged
alike; a column that has the name of an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: What stands between words before A-Z are lower-cased, and after.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase: label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# name words: (label, versions)
FAMILIES = {
    "gnu general public license": ("gpl", ("1", "2", "3", "1.0", "2.0", "3.0")),
    "gnu lesser general public license": ("lgpl", ("2", "2.1", "3", "3.0")),
    "gnu library general public license": ("lgpl", ("2", "2.0")),
    "gnu affero general public license": ("agpl", ("1", "3", "3.0")),
    "gnu free documentation license": ("gfdl", ("1.1", "1.2", "1.3")),
    "apache license": ("apache", ("1.0", "1.1", "2", "2.0")),
    "mozilla public license": ("mpl", ("1.0", "1.1", "2.0")),
    "eclipse public license": ("epl", ("1.0", "2.0")),
    "common development and distribution license": ("cddl", ("1.0", "1.1")),
    "common public license": ("cpl", ("1.0",)),
    "artistic license": ("artistic", ("1.0", "2.0")),
    "academic free license": ("afl", ("2.0", "2.1", "3.0")),
    "open software license": ("osl", ("1.0", "2.0", "2.1", "3.0")),
    "boost software license": ("bsl", ("1.0",)),
    "european union public licence": ("eupl", ("1.0", "1.1", "1.2")),
    "open database license": ("odbl", ("1.0",)),
    "sil open font license": ("ofl", ("1.0", "1.1")),
    "python software foundation license": ("psf", ("2",)),
    "microsoft public license": ("ms-pl", ()),
    "microsoft reciprocal license": ("ms-rl", ()),
    "mit license": ("mit", ()),
    "isc license": ("isc", ()),
    "zlib license": ("zlib", ()),
    "bsd license": ("bsd", ()),
    "bsd 2 clause license": ("bsd-2-clause", ()),
    "bsd 3 clause license": ("bsd-3-clause", ()),
    "new bsd license": ("bsd-3-clause", ()),
    "simplified bsd license": ("bsd-2-clause", ()),
    "ruby license": ("ruby", ()),
    "php license": ("php", ("3.0", "3.01")),
    "w3c license": ("w3c", ()),
    "x11 license": ("x11", ()),
}
CREATIVE = {"cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd"}
CREATIVE_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
    "spdx license identifier": "spdx",
}


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, regex over words joined by single spaces, label, priority), in order; notices and versions precede bare names."""
    out: list[tuple[str, str, str, int]] = []
    dots = lambda v: v.replace(".", " ")
    for text, label in NOTICES.items():
        out.append((max(text.split(), key=len), text, label, 40))
    for name, (label, versions) in FAMILIES.items():
        word = name.split()[-1]
        for v in versions:
            exact = f"{label}-{v}"
            out.append((word, f"{name}(?: the)?(?: as published by the free software foundation)?(?: either)? version {dots(v)}(?: \\d+)?(?: of the license)? or (?:at your option )?any later version", f"{exact}-or-later", 35))
            out.append((word, f"{name}(?: either)? (?:version|v) {dots(v)}(?! \\d)", exact, 30))
            out.append((word, f"{name} v?{dots(v)}(?! \\d)", exact, 30))
            if label.endswith("gpl"):
                out.append((label, f"{label} v?{dots(v)} only", f"{exact}-only", 28))
                out.append((label, f"{label} v?{dots(v)} or later", f"{exact}-or-later", 28))
        out.append((word, f"(?:licensed|released|distributed|available) under the(?: terms of the)? {name}", label, 20))
        out.append((word, name, label, 10))
    for name, label in CREATIVE.items():
        for v in CREATIVE_VERSIONS:
            out.append(("cc", f"{name} {dots(v)}", f"{label}-{v}", 30))
            out.append(("creative", f"creative commons {label.replace('cc-by', 'attribution').replace('-sa', ' sharealike').replace('-nd', ' noderivatives').replace('-nc', ' noncommercial')} {dots(v)}", f"{label}-{v}", 30))
        out.append(("cc", name, label, 10))
    return out


#: Every rule and base phrase has one of these, or the words `cc by`.
STEMS = ("licen", "creative", "permission", "redistribut", "unencumbered", "domain", "reserved", "identifier", "gpl")


def _gate(text: Column) -> Column:
    """Whether any rule can apply: plain substring tests of the lower-cased text, which only lets more through than A-Z alone."""
    low = F.lower(text)
    found = low.contains(STEMS[0])
    for stem in STEMS[1:]:
        found = found | low.contains(stem)
    return found | low.contains("cc") & low.rlike("cc[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+by")


def _marked(text: Column, regex: Column) -> Column:
    """The words, with \\x01 before each place's first word and \\x02 after its last; neither can stand in a word."""
    return F.split(F.trim(F.regexp_replace(text, F.concat(F.lit(" ("), regex, F.lit(")(?= )")), F.lit(" \u0001$1\u0002"))), " ")


def _where(marked: Column, mark: str, first: bool) -> Column:
    test = (lambda w: w.startswith(mark)) if first else (lambda w: w.endswith(mark))
    return F.filter(F.transform(marked, lambda w, i: F.when(test(w), i.cast("long"))), lambda i: i.isNotNull())


def _rows(table) -> Column:
    return F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("keyword", "regex", "label", "priority"), (k, rx, label, p), strict=True)), F.lit(i).alias("rank")) for i, (k, rx, label, p) in enumerate(table)])


def _found(norm: str, table, bag: str | None) -> Column:
    """(start, end, label, priority, rank) of every place of every rule whose keyword occurs."""
    chosen = _rows(table) if bag is None else F.filter(_rows(table), lambda r: F.array_contains(F.col(bag), r["keyword"]))

    def places(r: Column) -> Column:
        marked = F.when(F.regexp_like(F.col(norm), F.concat(F.lit(" "), r["regex"], F.lit(" "))), _marked(F.col(norm), r["regex"])).otherwise(F.array().cast("array<string>"))
        return F.transform(_intervals(marked), lambda x: F.struct(x["0"].alias("start"), x["1"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["rank"].alias("rank")))

    return F.flatten(F.transform(chosen, places))


def _intervals(marked: Column) -> Column:
    return F.arrays_zip(_where(marked, "\u0001", True).alias("0"), _where(marked, "\u0002", False).alias("1"))


@blocks.helpers("_norm", "_bag", "_base", "_all")
def scan(frame: DataFrame, column: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and `detections` (start and end word, label, priority; after suppression, in order)."""
    text = F.coalesce(F.col(column), F.lit(""))
    base = [(p.split()[-1], p, label, 0) for p, label in BASE.items()]
    every = rules()
    keys = F.array(*[F.lit(k) for k in sorted({k for k, *_ in every})])
    out = frame.withColumn("n_words", F.size(F.array_remove(F.split(text, BETWEEN), "")).cast("long"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = out.withColumn("_norm", F.when(_gate(text), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, upper, lower), GAP, " ")), F.lit(" "))))
    out = out.withColumn("_bag", F.array_intersect(F.split("_norm", " "), keys))
    out = out.withColumn("_base", F.coalesce(_found("_norm", base, None), F.array()))
    out = out.withColumn("_all", F.coalesce(_found("_norm", every, "_bag"), F.array()))
    beats = lambda o, d: (o["start"] <= d["start"]) & (o["end"] >= d["end"]) & (
        (o["priority"] > d["priority"]) | (o["priority"] == d["priority"]) & ((o["end"] - o["start"] > d["end"] - d["start"]) | (o["end"] - o["start"] == d["end"] - d["start"]) & (o["rank"] < d["rank"]))
    )
    out = out.withColumn("detections", F.array_sort(F.transform(F.filter("_all", lambda d: ~F.exists("_all", lambda o: beats(o, d))), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["priority"].alias("priority")))))
    labels = lambda x: F.transform(F.col(x), lambda d: d["label"])
    out = out.withColumns({
        "n_base": F.size("_base").cast("long"),
        "first_word": F.array_min(F.transform("_base", lambda d: d["start"])),
        "last_word": F.array_max(F.transform("_base", lambda d: d["start"])),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(labels("_base"))), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(labels("_base"), labels("detections")))), ","),
    })
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / F.lit(40.0)
    return out.withColumn("score", F.greatest(score.cast("double"), F.when(F.col("n_base") > 0, 0.25).otherwise(0.0))).drop("_norm", "_bag", "_base", "_all")
