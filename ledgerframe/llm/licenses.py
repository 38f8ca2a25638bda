"""License scans by a positional rare-token index.

A template is looked for where its mandatory key phrase stands, found from the phrase's rarest word over the whole corpus. There the
file's own words of highest inverse document frequency among the template's are looked up: their postings (positions in the template) give
offsets, where the template would have to begin, and are intersected by relative position: enough different words must agree within SLACK
words of the key phrase. Words put in or left out shift what follows, so an alignment is a chain of offsets, each borne by two
words or more, and a template word is in place if it stands there by any of them. What has enough of its words in place is found.

All of it is row by row in DataFrame expressions; only document frequencies of the templates' words (a fixed list) are
aggregated over the corpus, combined on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.shared import name

#: Fixed value: what separates words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, where A-Z belong to words.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every occurrence is a base finding, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    """A license text or notice: its label, the key phrase that must occur in an alignment, and its words."""

    label: str
    key: str
    text: str


#: The words of short public licenses, of their main parts, or of long notices.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
    "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or "
    "the use or other dealings in the software"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
    "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any "
    "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
    "contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
_ENDORSING = (
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission"
)
_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
    "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
    "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
    "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and "
    "to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you "
    "must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
    "would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the "
    "original software 3 this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
    "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
    "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
    "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see "
    "the license for the specific language governing permissions and limitations under the license"
)
_GPL = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation"
)
_GPL_NOTICE = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the "
    "free software foundation either version {version} of the license or at your option any later version this program is distributed in the hope that "
    "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
    "{kind}general public license for more details"
)
_MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
    "obtain one at http mozilla org mpl 2 0"
)

#: Label, mandatory key phrase and wording of public licenses and of their usual notices.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge", _MIT),
    Template("isc", "permission to use copy modify and or distribute this software", _ISC),
    Template("bsd", "redistribution and use in source and binary forms", _BSD),
    Template("bsd", "redistribution and use in source and binary forms", f"{_BSD} {_DISCLAIMER}"),
    Template("bsd-3", "to endorse or promote products derived from this software", f"{_BSD} {_ENDORSING} {_DISCLAIMER}"),
    Template("zlib", "permission is granted to anyone to use this software for any purpose", _ZLIB),
    Template("unlicense", "unencumbered software released into the public domain", _UNLICENSE),
    Template("apache-2", "licensed under the apache license version 2 0", _APACHE),
    Template("gpl", "under the terms of the gnu general public license", _GPL),
    Template("gpl-2", "either version 2 of the license", _GPL_NOTICE.format(kind="", version="2")),
    Template("gpl-3", "either version 3 of the license", _GPL_NOTICE.format(kind="", version="3")),
    Template("lgpl", "gnu lesser general public license", _GPL_NOTICE.format(kind="lesser ", version="3")),
    Template("agpl", "gnu affero general public license", _GPL_NOTICE.format(kind="affero ", version="3")),
    Template("mpl-2", "terms of the mozilla public license v 2 0", _MPL),
    Template("mit", "the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "apache license version 2", "the apache license version 2"),
    Template("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "under the terms of the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by", "creative commons attribution", "creative commons attribution 4 0 international license"),
    Template("cc0", "universal public domain dedication", "cc0 1 0 universal public domain dedication"),
    Template("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
)

#: Index words of a short template; of a longer one half of its different words, up to MOST_WORDS.
INDEX_WORDS = 4
MOST_WORDS = 60
#: Different index words that must agree on where a template stands.
AGREEING = 3
#: How far the offsets of a chain may be from that of the key phrase: so many words may have been put in or left out.
SLACK = 48
#: The least share of a template's words that must stand in place.
IN_PLACE = 0.6
#: Low bits of an offset's code, for the index word (from 1 on) that bears it; 0 is the key phrase.
_WORD_BITS = 6


def _constant(words: list[str]) -> Column:
    """An array of words (without blanks) as one literal, split."""
    return F.split(F.lit(" ".join(words)), " ")


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BREAKS, -1), "")


def document_frequencies(docs: DataFrame, text_column: str, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many texts each of the given words stands, and the number of texts. Words are lower-cased in full here."""
    found = F.array_intersect(F.split(F.lower(_text(name(text_column))), BREAKS, -1), _constant(words))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    total = counts.pop("", 0)
    return {w: counts.get(w, 0) for w in words}, total


def ranked(template: Template, frequencies: dict[str, int], total: int) -> list[str]:
    """The template's words, those of highest inverse document frequency first; of equally rare ones the longest, then the first."""
    words = dict.fromkeys(template.text.split())
    return sorted(words, key=lambda w: (-math.log((total + 1) / (frequencies[w] + 1)), -len(w)))


def index_words(template: Template) -> int:
    """How many of the template's words a file is looked up by."""
    return min(MOST_WORDS, max(INDEX_WORDS, len({*template.text.split()}) // 2))


def by_rarity(template: Template, frequencies: dict[str, int], total: int) -> list[str]:
    """The index words of a file that has all of the template's."""
    return ranked(template, frequencies, total)[: index_words(template)]


def _rarest(phrase: str, frequencies: dict[str, int]) -> int:
    """Place of the phrase's rarest word in it; of equally rare ones of the longest, then the first."""
    parts = phrase.split()
    return min(range(len(parts)), key=lambda k: (frequencies[parts[k]], -len(parts[k]), k))


# The steps of a scan are SQL expressions over the columns of those before: so many as Column calls would keep the driver busy for long.


def _literal(words: list[str], between: str = " ") -> str:
    """Words as one SQL string."""
    return "'" + between.join(words).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(phrase: str, anchor: int) -> str:
    """The places where a phrase stands, found from one of its words."""
    parts = phrase.split()
    stands = " AND ".join(f"get(words, i + {k - anchor}) <=> {_literal([word])}" for k, word in enumerate(parts) if k != anchor)
    word = _literal([parts[anchor]])
    places = f"filter(transform(words, (w, i) -> CASE WHEN w = {word} AND {stands or 'true'} THEN i - {anchor} END), p -> p IS NOT NULL)"
    return f"CASE WHEN array_contains(words, {word}) THEN {places} ELSE cast(array() AS array<int>) END"


def _codes(t: int, template: Template, order: list[str]) -> str:
    """Codes of the offsets that the file's index words (own) and the key phrases bear, in order; order: `ranked`."""
    parts, key = template.text.split(), template.key.split()
    key_at = next(k for k in range(len(parts)) if parts[k : k + len(key)] == key)
    # Spark folds this constant.
    postings = f"str_to_map({_literal([f'{w}:' + ' '.join(str(p) for p, part in enumerate(parts) if part == w) for w in order], ',')}, ',', ':')"
    positions = f"cast(split(element_at({postings}, w), ' ') AS array<int>)"
    borne = f"transform({positions}, p -> shiftleft(cast(i - p AS bigint), {_WORD_BITS}) | array_position(own{t}, w))"
    borne = f"array_distinct(flatten(filter(transform(words, (w, i) -> CASE WHEN array_contains(own{t}, w) THEN {borne} END), c -> c IS NOT NULL)))"
    keys = f"transform(keys{t}, q -> shiftleft(cast(q - {key_at} AS bigint), {_WORD_BITS}))"
    return f"CASE WHEN own{t} IS NOT NULL THEN sort_array(concat({borne}, {keys})) END"


def _offset(code: str) -> str:
    return f"shiftright({code}, {_WORD_BITS})"


def _bearer(code: str) -> str:
    return f"({code} & {(1 << _WORD_BITS) - 1})"


def _agreed(t: int, template: Template) -> str:
    """own (the code of a key phrase) and around (codes within SLACK of it) of each key phrase that enough index words agree on.

    In order of codes, all within SLACK of a key phrase are near it in the array, at most one for each offset and word, so each
    phrase looks at a slice of bounded length, however often the words occur."""
    reach = (SLACK + 1) * (index_words(template) + 1)
    about = f"slice(codes{t}, greatest(j + 1 - {reach}, 1), {2 * reach + 1})"
    around = f"filter({about}, d -> {_bearer('d')} <> 0 AND abs({_offset('d')} - {_offset('c')}) <= {SLACK})"
    found = f"transform(codes{t}, (c, j) -> CASE WHEN {_bearer('c')} = 0 THEN named_struct('own', c, 'around', {around}) END)"
    return f"filter({found}, x -> x IS NOT NULL AND size(array_distinct(transform(x.around, d -> {_bearer('d')}))) >= {AGREEING})"


def _chains(t: int) -> str:
    """The offsets of each chain: that of the key phrase and those that two words bear."""
    borne = f"filter(x.around, (d, i) -> {_offset('get(x.around, i + 1)')} = {_offset('d')})"
    return f"transform(agreed{t}, x -> array_distinct(concat(array({_offset('x.own')}), transform({borne}, d -> {_offset('d')}))))"


def _scores(t: int, template: Template) -> str:
    """Label and score of each chain that has enough of the template's words in place."""
    parts = template.text.split()
    in_place = f"exists(offsets, d -> get(words, cast(k + d AS int)) = get(split({_literal(parts)}, ' '), k))"
    scores = f"transform(chains{t}, offsets -> size(filter(sequence(0, {len(parts) - 1}), k -> {in_place})) / {len(parts)}D)"
    found = f"transform(filter({scores}, s -> s >= {IN_PLACE}D), s -> named_struct('label', {_literal([template.label])}, 'score', s))"
    return f"coalesce({found}, cast(array() AS array<struct<label:string,score:double>>))"


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A template is found where its key phrase stands, at least AGREEING of the file's index words agree on it within SLACK words, and at
    least IN_PLACE of its words are in place by an offset of the chain; up to SLACK words may have been put in or left out between
    the key phrase and any other part. Null and empty texts have no words and no labels. score is 1 where a base phrase stands, else the
    best template's share of words in place, else 0. Texts of any length are scanned whole; repeated rows come out each; other
    columns are not read; an empty table gives no rows.
    """
    vocabulary = sorted({w for text in (*(t.text for t in templates), *(p for p, _ in BASE)) for w in text.split()})
    frequencies, total = document_frequencies(docs, text_column, vocabulary)
    phrases = {p: _rarest(p, frequencies) for p in (*(p for p, _ in BASE), *(t.key for t in templates))}
    # No base phrase and no template without one of these words.
    anchors = sorted({p.split()[k] for p, k in phrases.items()})
    marked = "(?i)(?<![a-z0-9])(" + "|".join(anchors) + ")(?![a-z0-9])"

    text, words = _text(name(text_column)), F.col("words")
    n_words = F.size(F.regexp_extract_all(text, F.lit(_RAW_WORD), F.lit(0))).cast("long")
    rows = docs.select(name(id_column).alias("doc_id"), n_words.alias("n_words"), F.when(text.rlike(marked), _words(text)).alias("words"))

    # Each step is a column for each template, null where there is nothing to look at.
    def step(before: DataFrame, new: str, made: Callable[[int, Template], str]) -> DataFrame:
        return before.withColumns({f"{new}{t}": F.expr(made(t, template)) for t, template in enumerate(templates)})

    orders = [ranked(t, frequencies, total) for t in templates]
    rows = rows.withColumns({f"base{k}": F.expr(_places(phrase, phrases[phrase])) for k, (phrase, _) in enumerate(BASE)})
    rows = step(rows, "keys", lambda t, template: _places(template.key, phrases[template.key]))
    rows = step(rows, "own", lambda t, template: f"CASE WHEN size(keys{t}) > 0 THEN slice(array_intersect(split({_literal(orders[t])}, ' '), words), 1, {index_words(template)}) END")
    rows = step(rows, "codes", lambda t, template: _codes(t, template, orders[t]))
    rows = step(rows, "agreed", _agreed)
    rows = step(rows, "chains", lambda t, template: _chains(t))
    rows = step(rows, "scores", _scores)
    based = F.filter(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    found = F.struct(F.concat(*[F.col(f"base{k}") for k in range(len(BASE))]).alias("places"), based.alias("base"), F.concat(*[F.col(f"scores{t}") for t in range(len(templates))]).alias("more"))
    rows = rows.select("doc_id", "n_words", F.when(words.isNotNull(), found).alias("found"))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("found.base"), F.transform("found.more", lambda m: m["label"]))))
    best = F.when(F.size("found.base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found.more", lambda m: m["score"])), F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.when(F.col("found").isNotNull(), F.size("found.places")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("found.places").cast("long").alias("first_word"),
        F.array_max("found.places").cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort("found.base"), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.coalesce(F.when(F.col("found").isNotNull(), best), F.lit(0.0)).alias("score"),
    )
