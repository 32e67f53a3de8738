"""Phrases of notices and navigation words in prose are no boilerplate."""

from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from tableloom.llm.quality import ORACLE, line_fails, quality

PROSE = "The old printer kept every letter of the alphabet in a drawer and could find each of them in the dark without a lamp or a {} beside them. "
PHRASES = ("copyright", "terms of use", "privacy policy", "cookie policy", "page not found", "licensed under")
KEPT = ("Next we went home.", "Home is where the heart was", "Share the bread with everyone at the table.", "Previous owners had painted it green.", "The heirs held the copyright on all of the songs until 1950.")
DROPPED = (
    "All rights reserved.", "Copyright 2020 Jane Doe. All rights reserved.", "© 2021 Copyright Example", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "This work is licensed under the GNU General Public License, version 3.", "Privacy policy", "Next page", "Home > News > Today", "Read more...", "Log in to continue", "Back to Top", "Home",
)


def test_phrases_in_long_clean_lines(spark):
    more = " ".join(f"Then sentence{k} says that thing{k} met person{k} near place{k}." for k in range(40))
    rows = [(k, PROSE.format(p) + more * m) for k, (p, m) in enumerate((p, m) for p in PHRASES for m in (0, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality(docs).collect():
        assert r.kept and r.lost_words == 0 and r.clean_text == r.text, r.text[:140]


@pytest.mark.parametrize("lines, want", [(KEPT, False), (DROPPED, True)])
def test_lines(spark, lines, want):
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_fails(F.col("line")).alias("fails")).collect()
    assert [r.line for r in rows if r.fails != want] == []


OTHER_LANGUAGES = (
    "Tous droits réservés.", "Mentions légales", "Précédent", "Lire la suite", "Retour en haut", "Alle Rechte vorbehalten.", "Zurück zur Startseite", "Weiterlesen ...", "Datenschutzerklärung",
    "Todos los derechos reservados.", "Página no encontrada", "Iniciar sesión", "Leer más", "Siguiente >",
)
OTHER_PROSE = (
    "Weiter oben am Hang stand ein Haus, das niemand mehr bewohnte.", "Suivant le fleuve, ils marchèrent jusqu'au soir sans dire un mot.", "Anterior a todo aquello fue el silencio de la casa.",
    "Der Verlag hielt an allen Liedern fest, und alle Rechte vorbehalten zu wissen, war dem alten Mann eine stille Freude in jedem Jahr bis zu seinem Tod.", "Zurück im Dorf fanden sie das Tor offen.",
)


@pytest.mark.parametrize("lines, want", [(OTHER_PROSE, False), (OTHER_LANGUAGES, True)])
def test_lines_of_other_languages(spark, lines, want):
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_fails(F.col("line")).alias("fails")).collect()
    assert [r.line for r in rows if r.fails != want] == []


def test_ties_repeats_and_nulls(spark):
    """Equal rows get equal verdicts; a text without words is rejected."""
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (2, None), (3, " \n")]
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, 10, False, True)] * 2 + [(None, 10, False, True), (2, 0, True, False), (3, 0, True, False)]


def test_sql_states_the_same_rules(spark, tmp_path):
    """The SQL judges lines of all these kinds as the operator does, not only those of the driver's tables."""
    lines = [*KEPT, *DROPPED, *OTHER_LANGUAGES, *OTHER_PROSE, "### *** $$$ one", "Really?! Yes!! No!!", *(PROSE.format(p) for p in PHRASES)]
    more = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(k, f"{x}\n{more}") for k, x in enumerate(lines)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got, want = spark_rows(quality(docs).drop("text", "clean_text")), duck_rows(ORACLE, str(tmp_path))
    assert got == want
