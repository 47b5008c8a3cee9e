"""License scans by diagonal voting, with built-in functions and joins only.

Every run of k words of a text joins the places where license templates have the same run. Its position in the text less
its position in the template is a diagonal: a text that quotes a template gives many votes on one diagonal, and on
neighbouring ones where words were added or left out. Votes are summed by diagonal and neighbouring diagonals merge. A
merged span is then verified: the words of the template that its runs cover, each counted once however often the text repeats
it, must be enough of the template, and the words of the text that they cover enough of the span. Of spans that end together the best stays. Names of licenses are
templates too: a few words that must all stand.

Words: the text in lower case (A-Z), runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Null and empty texts have no words and no
spans. Very long texts: as any other; what is kept of a text are its hits. Equal rows (same id, same text) each get the same
result. Other columns of the documents aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbra.llm.common import ascii_lower, words_by, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The base phrases and labels of the contract. Fixed values.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Passages that license texts and notices share, in their public wording. Fixed values.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boost", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material for any purpose even commercially"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made you may do so in any reasonable manner but not in any way that suggests the licensor endorses you or your use"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("gpl", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache", "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions"),
    ("mpl", "each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights other than patent or trademark licensable by such contributor to use reproduce make available modify display perform distribute and otherwise exploit its contributions"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
]
PHRASE_K, NOTICE_K = 2, 4
#: Diagonals this near each other, of votes no farther apart in the text than LOOSE words, merge.
DRIFT, LOOSE = 4, 40
#: Least share of a notice's words that a span must cover, and of the span's own words that are the notice's.
LEAST, DENSE = 0.5, 0.5


def templates(spark: SparkSession) -> DataFrame:
    """(tpl, label, exact, k, need, hash-less run of words, place): one row for each run of k words of each template."""
    rows = []
    for tpl, (label, text, k, exact) in enumerate([*((b, a, PHRASE_K, True) for a, b in PHRASES), *((a, b, NOTICE_K, False) for a, b in NOTICES)]):
        words = text.split()
        runs = len(words) - k + 1
        rows += [(tpl, label, exact, k, runs, words[i : i + k], i) for i in range(runs)]
    made = spark.createDataFrame(rows, "tpl int, label string, exact boolean, k int, runs int, run array<string>, place int")
    return made.withColumn("hash", F.when(F.col("k") == PHRASE_K, F.xxhash64(*[F.get("run", F.lit(i)) for i in range(PHRASE_K)])).otherwise(F.xxhash64(*[F.get("run", F.lit(i)) for i in range(NOTICE_K)])))


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, tpl, label, exact, k, runs, place, pos): where a text has a run of words of a template; a written table.

    The templates are a fixed list of some 1400 runs, so they are broadcast; texts are read once and only their hits move on.
    """
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words_by(ascii_lower(F.coalesce(text_col, F.lit(""))), SEPARATORS).alias("words"))
    at = words.select("id", "text_hash", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))

    def run(k: int):
        following = [F.get("words", F.col("pos") + i) for i in range(1, k)]
        return F.when(F.col("pos") + k <= F.col("n"), F.xxhash64("word", *following))

    runs = at.select("id", "text_hash", "words", "pos", F.explode(F.array(run(PHRASE_K), run(NOTICE_K))).alias("hash"))
    known = templates(docs.sparkSession)
    found = runs.join(F.broadcast(known), "hash").where(F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("run"))
    return written(found.select("id", "text_hash", "tpl", "label", "exact", "k", "runs", "place", "pos"), "hits")


def _covered(starts, k):
    """Words in runs of k words with these distinct starts, sorted."""
    last = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.lit(1 << 30)))
    return F.aggregate(F.zip_with(starts, last, lambda a, b: F.least(b - a, k)), F.lit(0), lambda n, x: n + x)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, tpl, label, exact, start, end, score): license spans in words, end exclusive, one row each."""
    key = ["id", "text_hash", "tpl", "label", "exact", "k", "runs"]
    # Equal rows vote twice for the same place; a place on a diagonal counts once.
    places = hits(docs, id_col, text_col).select(*key, (F.col("pos") - F.col("place")).alias("diagonal"), "place", "pos").distinct()
    diagonals = places.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("place").alias("places"))

    whole = diagonals.where(F.col("exact") & (F.col("votes") == F.col("runs"))).select("id", "text_hash", "tpl", "label", "exact", F.col("low").alias("start"), (F.col("high") + F.col("k")).alias("end"), F.lit(1.0).alias("score"))

    loose = diagonals.where(~F.col("exact"))
    along = W.partitionBy("id", "text_hash", "tpl").orderBy("diagonal", "low")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT) | (F.abs(F.col("low") - F.lag("high").over(along)) > LOOSE)
    banded = loose.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("band", F.sum("fresh").over(along))
    # A diagonal's places are as many as the template's runs at most; a template has eighty words at most.
    pos = F.transform("places", lambda p: p + F.col("diagonal"))
    merged = banded.groupBy(*key, "band").agg(
        F.min("low").alias("start"), (F.max("high") + F.first("k")).alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(pos)))).alias("at")
    )
    length = F.col("runs") + F.col("k") - 1
    verified = merged.withColumns({"template": _covered(F.col("places"), F.col("k")), "text": _covered(F.col("at"), F.col("k"))})
    verified = verified.withColumn("covered", F.least("template", "text"))
    score = F.col("covered") / length
    fits = F.col("text") >= DENSE * (F.col("end") - F.col("start"))
    partial = verified.where((score >= LEAST) & fits).select("id", "text_hash", "tpl", "label", "exact", "start", "end", F.round(score, 6).alias("score"), "covered")
    # Licenses of a family share most words: of spans that end at the same word those with the best score stay, then those that cover most words;
    # as many as there are templates at most.
    value = F.struct("score", "covered")
    best = F.max(value).over(W.partitionBy("id", "text_hash", "end"))
    kept = partial.withColumn("best", best).where(value == F.col("best")).drop("best", "covered")
    return whole.unionByName(kept)


def query(docs: DataFrame) -> DataFrame:
    found = spans(docs)
    base = F.col("exact")
    by_doc = found.groupBy("id", "text_hash").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_by(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).cast("bigint").alias("n_words"))
    same = counted["doc_id"].eqNullSafe(by_doc["id"]) & (counted["text_hash"] == by_doc["text_hash"])
    none = F.lit("")
    return counted.join(by_doc, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
