"""License scans by diagonal voting."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm import _memory as M
from lanewise.llm import _words as W
from lanewise.llm._tables import cut, small_or_shuffled

# Phrases that name a licence, and notices and whole short licences in their public wording.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Words of a gram; diagonals this close are one; matched words that are enough, or the share that is.
GRAM, NEAR, ENOUGH, SHARE = 3, 2, 24, 0.8
#: Share of a notice that enough words are at least, as licences have phrases in common.
PART = 0.35


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for block in W.blocks(pa.array(texts, pa.string()), W.ALNUM_LOWER):
        out += [block.hashes[a:b] for a, b in zip(block.word_at[:-1], block.word_at[1:])]
    return out


def _word_lists(texts: list[str]) -> list[list[bytes]]:
    """The words of each text as bytes, A-Z as a-z."""
    out: list[list[bytes]] = []
    for block in W.blocks(pa.array(texts, pa.string()), W.ALNUM_LOWER):
        raw = block.buf.tobytes().lower()
        words = [raw[a:b] for a, b in zip(block.start.tolist(), block.end.tolist())]
        out += [words[a:b] for a, b in zip(block.word_at[:-1].tolist(), block.word_at[1:].tolist())]
    return out


def _verify(notices: list[tuple[str, str]], gram: int, enough: int, share: float):
    """Candidate spans (template, start, stop, first and last word of the template) of texts, compared
    word by word with the notices: matched counts the words of common runs, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_lists([t for _, t in notices])
        for batch in batches:
            found = []
            spans = batch.column("found").to_pylist()
            for i in range(0, batch.num_rows, 64):
                texts = _word_lists(batch.column("text").slice(i, 64).to_pylist())
                for row, words in enumerate(texts, i):
                    for s in spans[row]:
                        notice = known[s["template"]]
                        matched = _common(words[s["start"] : s["stop"]], notice[s["t_start"] : s["t_stop"]], gram)
                        if matched >= share * len(notice) or matched >= enough and matched >= PART * len(notice):
                            found.append((row, notices[s["template"]][0], s["start"], s["stop"], matched, matched / len(notice)))
            row, *rest = zip(*found) if found else ((),) * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([batch.column("key").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds))], names=["key", "label", "start", "stop", "matched", "share"])

    return run


def _common(a: list[bytes], b: list[bytes], gram: int) -> int:
    """Words of the common runs of ``gram`` or more words, in order."""
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= gram)


def template_grams(spark: SparkSession, notices: list[tuple[str, str]], gram: int) -> DataFrame:
    """gram, template, t_at, t_words, label for each gram of each notice."""
    rows = []
    for n, ((label, _), hashes) in enumerate(zip(notices, _word_hashes([t for _, t in notices]))):
        rows += [(h, n, at, len(hashes), label) for at, h in enumerate(W.signed(W.gram_hashes(hashes, gram)).tolist())]
    return spark.createDataFrame(rows, "gram bigint, template int, t_at bigint, t_words bigint, label string")


def _scan(phrases: dict[str, str], known: np.ndarray, gram: int):
    names = list(phrases.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _word_hashes(list(phrases))
        for batch in batches:
            rows = batch.num_rows
            words, places = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            has = np.zeros((len(names), rows), bool)
            hits: list[list[dict]] = [[] for _ in range(rows)]
            for block in W.blocks(batch.column("text"), W.ALNUM_LOWER):
                words[block.first : block.first + len(block)] = np.diff(block.word_at)
                text_of = block.text_of_word()
                for p, phrase in enumerate(wanted):
                    k = len(phrase)
                    n = len(block.hashes) - k + 1
                    if n <= 0:
                        continue
                    same = block.hashes[:n] == phrase[0]
                    at = np.flatnonzero(same)
                    for j in range(1, k):
                        at = at[block.hashes[at + j] == phrase[j]]
                    at = at[text_of[at] == text_of[at + k - 1]]
                    row, word = block.first + text_of[at], at - block.word_at[text_of[at]]
                    np.add.at(places, row, 1)
                    np.minimum.at(first, row, word)
                    np.maximum.at(last, row, word)
                    has[p, row] = True
                hashes = W.gram_hashes(block.hashes, gram)
                slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                at = np.flatnonzero((known[slot] == hashes) & W.gram_starts(block.word_at, gram)) if len(hashes) else []
                for a, t in zip(at, text_of[at] if len(at) else []):
                    hits[block.first + t].append({"gram": int(hashes[a].view(np.int64)), "at": int(a - block.word_at[t])})
            found = last >= 0
            labels = [[names[p] for p in np.flatnonzero(has[:, i])] if found[i] else [] for i in range(rows)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(words), pa.array(places), pa.array(first, mask=~found), pa.array(last, mask=~found), pa.array(labels, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())])))],
                names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "named", "hits"],
            )

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, gram: int = GRAM, near: int = NEAR, enough: int = ENOUGH, share: float = SHARE, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_base, first_word, last_word (of the phrases),
    named (labels of phrases), noticed (labels of notices: array), spans (label, start, stop,
    matched, share of each verified notice), score (1 for a phrase, else the largest share).

    Every word gram of a text that some notice has too is joined to the notice's positions and
    votes for a diagonal, its position less the notice's. Diagonals no more than ``near`` apart
    merge, which lets a word be added or left out. A merged group whose grams cover ``enough`` words
    of the notice, or ``share`` of it, is verified: the words of its span are compared with the
    notice's, and those of common runs of ``gram`` words or more must be ``share`` of the notice, or
    ``enough`` and PART of it.

    The notices are constants of this module or arguments of the caller, so their grams are few
    and sieve the texts' grams inside the scan; only matches are shuffled, by text, so that a text
    found in many documents votes once.

    Null text counts as empty: no words, no labels, score 0. Rows alike are judged alike, each by
    itself. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    doc_id, text = columns
    grams = template_grams(spark, notices, gram)
    known = np.unique(np.concatenate([W.gram_hashes(h, gram) for h in _word_hashes([t for _, t in notices])] or [np.zeros(0, np.uint64)]))
    if not len(known):
        known = np.zeros(1, np.uint64)
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key"))
    scanned = source.mapInArrow(
        M.batches(_scan(phrases, known, gram)),
        f"doc_id {kind}, key string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, named array<string>, hits array<struct<gram:bigint,at:bigint>>",
    )
    scanned = cut(scanned)
    hits = scanned.filter(F.size("hits") > 0).select("key", F.inline("hits")).distinct()
    votes = hits.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("at") - F.col("t_at"))
    votes = votes.groupBy("key", "template", "label", "t_words", "diagonal").agg(F.collect_set("t_at").alias("t_at"), F.min("at").alias("start"), (F.max("at") + gram).alias("stop"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    votes = votes.withColumn("fresh", (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 40)).over(along) > near).cast("int"))
    votes = votes.withColumn("run", F.sum("fresh").over(along))
    merged = votes.groupBy("key", "template", "label", "t_words", "run").agg(F.flatten(F.collect_list("t_at")).alias("t_at"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_at", lambda t: F.sequence(t, t + gram - 1))))).cast("long")
    merged = merged.withColumn("covered", covered).filter((F.col("covered") >= enough) | (F.col("covered") >= share * F.col("t_words")))
    spans = merged.select("key", F.struct("template", "start", "stop", F.array_min("t_at").alias("t_start"), (F.array_max("t_at") + gram).alias("t_stop")).alias("span"))
    spans = cut(spans.groupBy("key").agg(F.collect_list("span").alias("found")))
    texts = source.select("key", "text").join(small_or_shuffled(spans.select("key")), "key", "left_semi").dropDuplicates(["key"])
    verified = texts.join(spans, "key").mapInArrow(M.batches(_verify(notices, gram, enough, share)), "key string, label string, start bigint, stop bigint, matched bigint, share double")
    noticed = verified.groupBy("key").agg(
        F.array_sort(F.collect_set("label")).alias("noticed"), F.array_sort(F.collect_list(F.struct("start", "stop", "label", "matched", "share"))).alias("spans"), F.max("share").alias("best")
    )
    out = scanned.drop("hits").join(small_or_shuffled(noticed), "key", "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "named",
        F.coalesce("noticed", F.array().cast("array<string>")).alias("noticed"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint,label:string,matched:bigint,share:double>>")).alias("spans"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
