"""Line-first quality rules, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, pick

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Lower-case patterns of lines that are not the document's own prose, in English, French, German and Spanish.
BOILERPLATE = (
    r"all rights reserved|\bcopyright\b|licensed under|is licensed under|released under the [a-z0-9 .-]* ?licen[cs]e"
    r"|terms of (use|service)|privacy policy|cookie (policy|settings|consent)|\b(enable|requires?) javascript\b"
    r"|lorem ipsum|subscribe to our newsletter|page not found"
    r"|tous droits réservés|droits d.auteur|sous licence|conditions (générales )?d.utilisation|politique de confidentialité|mentions légales|page introuvable"
    r"|alle rechte vorbehalten|urheberrechtlich geschützt|lizenziert unter|nutzungsbedingungen|datenschutzerklärung|seite nicht gefunden"
    r"|todos los derechos reservados|derechos de autor|bajo la licencia|términos de (uso|servicio)|política de privacidad|aviso legal|página no encontrada"
)
#: Of each of these phrases, a part that it cannot lack: lines without any are not searched for patterns.
BOILERPLATE_PARTS = (
    "reserved copyright licen javascript policy cookie newsletter droits utilisation politique mentions introuvable vorbehalten geschützt lizenziert"
    " nutzungsbedingungen datenschutz gefunden derechos términos privacidad encontrada"
).split() + ["terms of", "lorem ipsum", "not found", "aviso legal"]
#: Words that a line of NAVIGATION can have: four of the phrase, and those of 40 characters.
NAVIGATION_WORDS = 24
#: Words and phrases of links in the same languages: alone or with few words after them, and with any.
LINK_WORDS = "accueil|suivant|précédent|connexion|startseite|weiter|zurück|inicio|siguiente|anterior"
LINK_PHRASES = "se connecter|lire la suite|retour en haut|cliquez ici|anmelden|weiterlesen|nach oben|hier klicken|iniciar sesión|leer más|volver arriba|haga clic aquí"
#: Lower-case patterns of lines that lead elsewhere.
NAVIGATION = (
    r"^\s*(home|menu|sign in|log ?in|register|next|previous|back to top|skip to (main )?content|read more|click here|share( this)?)\b.{0,40}$"
    rf"|^\s*({LINK_WORDS}|{LINK_PHRASES})(\s.{{0,40}})?$"
)
#: Share of a line's words that boilerplate phrases must have, unless the line begins as a notice and is short.
PHRASE_SHARE, NOTICE_WORDS = 1 / 8, 40
#: Lower-case beginnings of notices.
NOTICE = r"^\W*(copyright\W*(©|\(c\)|\d{4})|all rights reserved|((this|the) \S+ (\S+ )?is )?licensed under|released under the )"
#: Lines in the form of links: the phrase alone, or without a sentence's end a phrase, few words, capitalised words or entries with separators.
LINK_ALONE = rf"(?i)^\s*(sign in|log ?in|back to top|skip to (main )?content|read more|click here|share this|{LINK_PHRASES})\W*$"
LINK = (
    rf"^\s*((?i:home|menu|sign in|log ?in|register|next|previous|share|{LINK_WORDS})(\s+\S+){{0,2}}|\S+\s*[|>»›·•→:].*"
    rf"|(?i:sign in|log ?in|back to top|skip to (main )?content|read more|click here|share this|{LINK_PHRASES})\b.*|(\p{{Lu}}\S*\s*)+)$"
)
SENTENCE_END = r"[.!?…,;][\"'”’)]*\s*$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, width: int) -> Column:
    """Words that lie in a window of `width` words which the text holds twice or more.

    Windows are compared by 64-bit hashes of their words' hashes.
    """

    def covered(windows: Column) -> Column:
        def of(ordered: Column) -> Column:
            twice = F.filter(
                ordered,
                lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | (F.get(ordered, k + 1)["h"] == x["h"]),
            )
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            step = F.aggregate(
                starts,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda acc, i: F.struct((i + width).alias("end"), (acc["n"] + i + width - F.greatest(acc["end"], i)).alias("n")),
            )
            return step["n"]

        numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(F.sort_array(numbered), of))

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width))))

    return _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) <= width, 0).otherwise(_let(windows(h), covered)),
    )


def line_fails(line: Column, min_symbol_share: float = 0.3, min_shout_share: float = 0.5) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule.

    Punctuation: a symbol of ``#*$%&|<>`` for at least `min_symbol_share` of
    its words, or that share `min_shout_share` of its words ending in two or
    more of ``!?``.  Navigation: bars, arrows or chevrons standing between
    short entries count as symbols; a short line that begins with a
    navigation word and has the form of a link, not of a sentence.
    Boilerplate: phrases of notices of rights, licences, cookies that are at
    least `PHRASE_SHARE` of the line's words, or a line of up to
    `NOTICE_WORDS` words that begins as a notice does.  A phrase in prose does
    not count, however long the line.  A line without words breaks none.
    """

    def judged(low: Column, n: Column) -> Column:
        phrases = F.regexp_count(F.array_join(F.regexp_extract_all(low, F.lit(BOILERPLATE), 0), " "), F.lit(WORD))
        may_hold = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE_PARTS])
        return (n > 0) & (
            (F.regexp_count(line, F.lit(r"[#*$%&|<>]+")) >= min_symbol_share * n)
            | (F.regexp_count(line, F.lit(r"[!?]{2,}")) >= min_shout_share * n)
            | ((n <= NAVIGATION_WORDS) & low.rlike(NAVIGATION) & (line.rlike(LINK_ALONE) | (~line.rlike(SENTENCE_END) & line.rlike(LINK))))
            | (may_hold & low.rlike(BOILERPLATE) & ((phrases >= PHRASE_SHARE * n) | ((n <= NOTICE_WORDS) & low.rlike(NOTICE))))
        )

    return _let(F.lower(line), lambda low: _let(F.regexp_count(line, F.lit(WORD)), lambda n: judged(low, n)))


def figures(text: Column, *, min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 60, window: int = 5) -> Column:
    """A struct of what `quality` returns for a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: x.rlike(WORD))
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))

    def verdict(x: Column) -> Column:
        n, repeated, lost = x["n_words"], x["n_repeat_words"], x["lost_words"]
        failed = (n < min_words) | (100 * repeated > max_repeat_percent * n)
        names = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")
        return F.struct(
            *(x[name].alias(name) for name in names),
            failed.alias("base_failed"),
            (~failed & (100 * lost <= max_lost_percent * n)).alias("kept"),
        )

    def cleaned(x: Column) -> Column:
        left = F.transform(F.filter(x, lambda y: ~y["fails"]), lambda y: y["line"])
        lost = F.aggregate(F.filter(x, lambda y: y["fails"]), F.lit(0).cast("long"), lambda n, y: n + F.regexp_count(y["line"], F.lit(WORD)))
        return F.struct(F.array_join(left, "\n").alias("clean_text"), lost.alias("lost_words"))

    def counted(lines_: Column) -> Column:
        return _let(words, lambda w: _let(F.struct(
            lines_["clean_text"].alias("clean_text"),
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w, window).cast("long").alias("n_repeat_words"),
            lines_["lost_words"].alias("lost_words"),
        ), verdict))

    return _let(judged, lambda x: _let(cleaned(x), counted))


def quality(docs: DataFrame, *, keep: tuple[str, ...] = (), **rules: int) -> DataFrame:
    """Base figures, the cleaned text and a verdict for each document.

    Input: `doc_id` and `text`; further columns are ignored, but for those
    named in `keep`, which go first.  Output: doc_id, text, clean_text,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
    base_failed, kept; one row for each input row, repeated rows included.
    Rules: see `figures`.

    Lines are judged first (`line_fails`); those that fail are removed, and a
    document that loses more than `max_lost_percent` of its words with them is
    rejected.  A null or empty text has no words, so base_failed is true and
    kept false; its clean_text is empty.  A text of any length is one row's
    work; nothing is shuffled.
    """
    d = pick(docs, *keep, "doc_id", text="string")
    return d.withColumn("_q", figures(F.col("text"), **rules)).select(*keep, "doc_id", "text", "_q.*")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: What quality() returns over `documents`, without its text columns, as DuckDB SQL.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
g AS (
  SELECT r, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(i)
),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 5)) AS t(j) GROUP BY r),
l AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, unnest(ls) AS line FROM w)
),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY r),
lost AS (
  SELECT r, sum(n) AS n FROM l WHERE n > 0 AND (
    len(regexp_extract_all(line, '[#*$%&|<>]+')) >= 0.3 * n
    OR len(regexp_extract_all(line, '[!?]{{2,}}')) >= 0.5 * n
    OR (regexp_matches(lower(line), {_quoted(NAVIGATION)}) AND (regexp_matches(line, {_quoted(LINK_ALONE)})
      OR (NOT regexp_matches(line, {_quoted(SENTENCE_END)}) AND regexp_matches(line, {_quoted(LINK)}))))
    OR (regexp_matches(lower(line), {_quoted(BOILERPLATE)}) AND (8 * len(regexp_extract_all(array_to_string(regexp_extract_all(lower(line), {_quoted(BOILERPLATE)}), ' '), '[^\x20\x09-\x0D]+')) >= n
      OR (n <= {NOTICE_WORDS} AND regexp_matches(lower(line), {_quoted(NOTICE)}))))) GROUP BY r
),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 60 * n_words AS kept
FROM f
"""
