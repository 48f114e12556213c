"""License scans by sentence rules.

Main path: DataFrame and SQL functions only.

A document is cut into lines and sentences. A known licence sentence, which may be
wrapped over several lines, with or without comment marks, is cut out as a whole;
where one known sentence begins with another, the longer is taken. In lower case,
with runs of other characters turned into a space, it is looked up among the known
sentences, which gives the document's sequence of sentence identifiers, with a mark
where other text stands between. Copyright lines and list numbers count as nothing.
A rule is an ordered list of identifiers; it matches where the list occurs in the
sequence. Rules are ordered: a rule's match takes its sentences, and a later rule sees
what is left. Rules of whole licence texts come first, then shorter notices.

Defined cases
    null or empty text    no sentences, no licences
    null doc_id           scanned like others
    repeated rows         each gives its own row
    ties                  the rule that comes first takes the sentences
    very long texts       scanned whole
    empty table           empty result
    extra columns         not read
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm.licence_texts import GNU_NOTICES, GNU_TITLES, TEXTS, gnu_notice
from resonant.llm.shared import documents, text_of

# Licence sentences as normalised, and the rules over their identifiers.
SENTENCES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-2.0-comply": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-as-is": "the software is provided as is without warranty of any kind",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "cc-by-4.0-notice": "licensed under cc by 4 0",
    "cc-by-sa-4.0-notice": "licensed under cc by sa 4 0",
    "cc0-1.0-notice": "licensed under cc0 1 0",
    "reserved": "all rights reserved",
}
RULES = [
    ("Apache-2.0", ["apache-2.0-notice-the", "apache-2.0-comply", "apache-2.0-copy"]),
    ("Apache-2.0", ["apache-2.0-notice-the", "apache-2.0-comply"]),
    ("MIT", ["mit-grant", "mit-as-is"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("Apache-2.0", ["apache-2.0-notice"]),
    ("Apache-2.0", ["apache-2.0-notice-the"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-licensed"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0-only", ["gpl-3.0-notice"]),
    ("BSD", ["bsd-redistribution"]),
    ("MPL-2.0", ["mpl-2.0-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-notice"]),
    ("CC-BY-4.0", ["cc-by-4.0-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-notice"]),
    ("CC0-1.0", ["cc0-1.0-notice"]),
    ("Proprietary", ["reserved"]),
]

#: A line break, or white space after the end of a sentence.
SPLIT = r"[\n\r]+|[.!?]+[ \t]+"
#: Stands for the end of a sentence, and around known sentences that were found.
END, OPEN, CLOSE = "\x01", "\x02", "\x03"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def sentences_of(text: str) -> list[str]:
    """The normalised sentences of a licence text, in order; list numbers are left out."""
    cut = re.split(r"\n\s*\n|[.!?]+(?=\s|$)", text)
    return [s for s in map(normalised, cut) if re.search("[a-z]{2}", s)]


@dataclass(frozen=True)
class LicenceRules:
    """Normalised sentences by identifier, and (licence, identifiers) in order of preference."""

    sentences: dict[str, str]
    rules: list[tuple[str, list[str]]]

    @property
    def numbers(self) -> dict[str, int]:
        return {name: k + 1 for k, name in enumerate(self.sentences)}

    @property
    def words(self) -> list[str]:
        """Words, long ones first, of which each sentence has one: a text without any holds no known sentence."""
        left = {name: set(s.split(" ")) for name, s in self.sentences.items()}
        out = []
        while left:
            least = min(6, min(max(map(len, w)) for w in left.values()))
            usable = {x for w in left.values() for x in w if len(x) >= least}
            best = max(usable, key=lambda x: (sum(x in w for w in left.values()), len(x), x))
            out.append(best)
            left = {name: w for name, w in left.items() if best not in w}
        return out

    @property
    def pattern(self) -> str:
        """A regular expression for any known sentence or copyright line, as a whole, over line breaks."""
        gap, mark = f"[^a-z0-9{END}]++", rf"[^a-z0-9\n\r{END}]*+"
        trie: dict = {}
        for s in self.sentences.values():
            at = trie
            for word in s.split(" "):
                at = at.setdefault(word, {})
            at[""] = {}
        stop = rf"(?={mark}(?:[\n\r{END}]|\z))"

        def branch(at: dict) -> str:
            parts = [re.escape(w) + (branch(n) if list(n) == [""] else gap + branch(n) if "" not in n else f"(?:{gap}{branch({k: v for k, v in n.items() if k})}|{stop})") for w, n in at.items() if w]
            if not parts:
                return stop
            return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

        year = rf"copyright[^a-z0-9\n\r]*+(?:c[^a-z0-9\n\r]++)?(?:[0-9]{{4}}|yyyy|year)[^\n\r{END}]*+"
        return rf"(?<![^\n\r{END}]){mark}({branch(trie)}|{year})"


def _known() -> LicenceRules:
    """The notices above, the licence texts, and the rules over both."""
    sentences, numbers = dict(SENTENCES), {s: name for name, s in SENTENCES.items()}

    def named(text: str, prefix: str) -> list[str]:
        out = []
        for k, s in enumerate(sentences_of(text)):
            if s not in numbers:
                numbers[s] = f"{prefix}-{k}"
                sentences[numbers[s]] = s
            out.append(numbers[s])
        return out

    whole, titles, first = [], [], []
    for licence, title, text in TEXTS:
        ids = named(text, licence)
        over = [*named(title, f"{licence}-title"), *named(f"The {title} ({licence})", f"{licence}-the-title")]
        # all rights reserved, which older texts have after the copyright line, is part of a whole text
        whole += [(licence, [*start, *ids]) for t in over for start in ([t, "reserved"], [t])] + [(licence, ["reserved", *ids]), (licence, ids)]
        titles += [(licence, [t]) for t in over]
        first.append((licence, ids[:1]))
    whole = [("Apache-2.0", ["apache-2.0-notice-the", "apache-2.0-comply", "apache-2.0-copy", *named("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "apache-2.0-terms")]), *whole]
    titles.append(("Apache-2.0", named("Apache License Version 2.0, January 2004", "apache-2.0-title")))
    titles.append(("CC0-1.0", named("CC0 1.0 Universal", "cc0-1.0-title")))
    for licence, kind, name, version in GNU_NOTICES:
        notice = gnu_notice(kind, name, version)
        ids = named(notice.replace("but WITHOUT ANY WARRANTY; without", "but WITHOUT ANY WARRANTY. without"), licence)
        whole += [(licence, ids), (licence, ids[:3]), (licence, ids[:2])]
        first.append((licence, ids[:1]))
    for licence, title in GNU_TITLES:
        titles.append((licence, named(title, f"{licence}-title")))
    # a first sentence that begins several texts tells none of them apart from the others
    shared = [ids[0] for _, ids in first]
    first = [(licence, ids) for licence, ids in first if shared.count(ids[0]) == 1]
    rules = [*sorted(whole, key=lambda r: -len(r[1])), *RULES, *first, *titles]
    taken: set[tuple[str, ...]] = set()
    return LicenceRules(sentences, [r for r in rules if not (tuple(r[1]) in taken or taken.add(tuple(r[1])))])


DEFAULT = _known()


def sentence_numbers(text: Column, known: LicenceRules) -> Column:
    """The numbers of the known sentences in the text, 0 where other text stands between."""
    out = F.translate(F.lower(text), END + OPEN + CLOSE, "---")
    out = F.regexp_replace(out, r"[.!?]+[ \t]+", f"{END}\n")
    out = F.regexp_replace(out, r"[.!?]+(?=[\n\r])", END)
    out = F.regexp_replace(out, r"([:;])[ \t]+", "$1\n")
    pieces = F.split(F.regexp_replace(out, known.pattern, f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]")
    lookup = F.create_map(*[F.lit(x) for name, s in known.sentences.items() for x in (s, known.numbers[name])])
    cleaned = lambda p: F.trim(F.regexp_replace(p, "[^a-z0-9]+", " "))
    # every second piece was found: a known sentence, or a copyright line
    number = lambda p, k: F.when(k % 2 == 1, F.try_element_at(lookup, cleaned(p))).when(p.rlike("[a-z]{2}"), F.lit(0))
    return F.filter(F.transform(pieces, number), lambda n: n.isNotNull())


def scan(docs: DataFrame, known: LicenceRules = DEFAULT) -> DataFrame:
    """One row per document: doc_id, licences (sorted, distinct), sentences (known ones), matches.

    Each document is read once, and nothing moves between machines. The sequence is
    written as text, one mark per sentence, and a rule is a literal search in it, so
    that its cost does not depend on the number of matches.
    """
    text = text_of()
    near = F.lit(False)
    for word in known.words:
        near = near | F.contains(F.lower(text), F.lit(word))
    mark = lambda n: F.format_string("<%d>", n)
    numbers = F.when(near, sentence_numbers(text, known)).otherwise(F.array().cast("array<int>"))
    df = docs.select("doc_id", numbers.alias("__numbers"))
    df = df.select("doc_id", F.filter("__numbers", lambda n: n > 0).alias("__known"), F.array_join(F.transform("__numbers", mark), "").alias("__left"))
    rule = lambda name, ids: F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{known.numbers[n]}>" for n in ids)).alias("pattern"))
    rules = F.array(*[rule(*r) for r in known.rules])
    start = F.struct(F.col("__left").alias("left"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))

    def take(state: Column, r: Column) -> Column:
        left = F.replace(state["left"], r["pattern"], F.lit("<0>"))
        n = (F.length(state["left"]) - F.length(F.replace(state["left"], r["pattern"], F.lit("")))) / F.length(r["pattern"])
        found = F.struct(left.alias("left"), (state["n"] + n.cast("long")).alias("n"), F.concat(state["names"], F.array(r["name"])).alias("names"))
        return F.when(F.contains(state["left"], r["pattern"]), found).otherwise(state)

    result = F.when(F.size("__known") > 0, F.aggregate(rules, start, take)).otherwise(start)
    df = df.select("doc_id", "__known", result.alias("__result"))
    return df.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("__result.names")), "+").alias("licences"),
        F.size("__known").cast("long").alias("sentences"),
        F.col("__result.n").alias("matches"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def oracle(known: LicenceRules = DEFAULT) -> str:
    """The same scan for DuckDB, with the rules applied one after another."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(s)}, {known.numbers[n]})" for n, s in known.sentences.items())
    steps, last = [], "s0"
    for k, (_, names) in enumerate(known.rules):
        pattern = quoted("".join(f"<{known.numbers[n]}>" for n in names))
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest), (length(rest) - length(replace(rest, {pattern}, ''))) // length({pattern}) AS m{k}, replace(rest, {pattern}, '<0>') AS rest FROM {last})")
        last = f"r{k}"
    hits = ", ".join(f"CASE WHEN m{k} > 0 THEN {quoted(name)} END" for k, (name, _) in enumerate(known.rules))
    total = " + ".join(f"m{k}" for k in range(len(known.rules)))
    return f"""
WITH known(sentence, n) AS (VALUES {values}),
pieces AS (
  SELECT doc_id, rn, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rn, regexp_split_to_array(lower(coalesce(text, '')), '[\\n\\r]+|[.!?]+[ \\t]+') AS p FROM documents)
), found AS (
  SELECT doc_id, rn, pos, coalesce(n, 0) AS n
  FROM (SELECT doc_id, rn, pos, trim(regexp_replace(piece, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM pieces WHERE trim(piece) <> '')
  LEFT JOIN known USING (sentence) WHERE n IS NOT NULL OR regexp_matches(sentence, '[a-z][a-z]')
), s0 AS (
  SELECT d.doc_id, d.rn, coalesce(f.sentences, 0) AS sentences, coalesce(f.rest, '') AS rest
  FROM (SELECT DISTINCT doc_id, rn FROM pieces) d
  LEFT JOIN (SELECT rn, count(*) FILTER (n > 0) AS sentences, string_agg('<' || n || '>', '' ORDER BY pos) AS rest FROM found GROUP BY rn) f USING (rn)
), {", ".join(steps)}
SELECT doc_id,
  array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), '+') AS licences,
  CAST(sentences AS BIGINT) AS sentences, CAST({total} AS BIGINT) AS matches
FROM {last}
"""


SQL = oracle()
