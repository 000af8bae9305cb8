"""Stages of the corpus pipeline against plain Python."""

import random

import corpus_pipeline
from graphloom.llm.common import documents

from . import brute
from .conftest import SF, texts_of


def test_stages(spark, small):
    docs = documents(spark, small)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            assert set(after) == {i for i, t in before.items() if not brute.quality(t)[5]}
        elif name == "near_copies":
            assert set(after) == {i for i, (_, _, kept) in brute.near_duplicates(before.items()).items() if kept}
        elif name == "repeated_passages":
            assert set(after) == set(before)
            same = brute.suffix_dedup(before.items())
            assert all(after[i] == before[i] for i in after if same[i][1] == 0)
            assert all(len(after[i].encode()) >= same[i][0] - same[i][1] for i in after)
        else:
            assert set(after) <= set(before) and all(any(c.isalpha() for c in t) for t in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == set(after) and texts_of(small)


def test_language_rejects_by_score(spark):
    """Texts of languages that no label names and random letters go; short clean texts stay."""
    rand = random.Random(1)
    gone = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        *(" ".join("".join(rand.choices("abcdefghijklmnopqrstuvwxyz", k=rand.randint(2, 9))) for _ in range(n)) for n in (10, 50, 300)),
    ]
    stay = ["Hello world", "The cat sat on the mat and looked at the dog.", "El perro duerme en la casa de mi abuela.", "Le chat dort sur la table de la cuisine.", "Der Hund schläft heute in der Küche."]
    docs = documents(spark, SF).select(*corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(gone + stay)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    assert {-1 - i for i in range(len(gone + stay))} & kept == {-1 - i for i in range(len(gone), len(gone + stay))}
    own = [i for i, t in texts_of(SF) if any(c.isalpha() for c in t or "")]
    assert sum(i in kept for i in own) > 0.99 * len(own)
