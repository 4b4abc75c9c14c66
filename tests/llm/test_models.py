"""Quality rules and language identification: held-out accuracy, folds, exact paths and odd rows."""

import itertools
import os
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from cases import ODD, counted, documents, held_out, no_docs, odd_docs, same_rows_left  # noqa: E402

from tessera.llm import op04_rules, op08_language, registry  # noqa: E402
from tessera.llm.shared import held_out_fold  # noqa: E402

LARGER = "/root/testdata/sf0.01"


# 4: quality


def test_quality_of_held_out_documents(spark):
    rows = registry.queries()["op4_rule_ensemble"](spark, LARGER).collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents(spark, LARGER).collect())
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    judged = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    right = sum(a == b for a, b in judged) / len(judged)
    most_common = max(sum(b for _, b in judged), sum(1 - b for _, b in judged)) / len(judged)
    assert len(judged) > 80 and right >= max(0.9, most_common), (right, most_common, len(judged))


def small_labels(spark, docs):
    """Label 1 for texts with lower-case words only, over ids 0 to 59."""
    return docs.select("doc_id", F.when(F.col("text").rlike("[A-Z]"), 0).otherwise(1).alias("quality")).where("doc_id is not null")


def made_docs(spark, n=60):
    return odd_docs(spark, [(i, ("plain words in a row number " if i % 2 else "SHOUTED WORDS!! | | $$$ ") * (1 + i % 5)) for i in range(n)])


def test_held_out_labels_do_not_matter(spark):
    docs = made_docs(spark)
    labels, fold = small_labels(spark, docs), held_out_fold(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    kept = [sorted(r["doc_id"] for r in op04_rules.good_documents(docs, x, ~fold).collect()) for x in (labels, turned)]
    assert kept[0] == kept[1] == [i for i in range(60) if i % 2]


def test_quality_keeps_columns_and_odd_rows(spark):
    docs = odd_docs(spark)
    labels = small_labels(spark, docs).unionByName(spark.createDataFrame([(99, 1), (1, None), (None, 1)], "doc_id long, quality int"))
    kept = op04_rules.good_documents(docs, labels)
    assert same_rows_left(kept, docs) and 0 < kept.count() <= len(ODD)
    assert op04_rules.good_documents(no_docs(spark), labels).count() == 0
    # labels of one kind, and none
    ones = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, quality int")
    assert op04_rules.good_documents(docs, ones).count() == len(ODD)
    assert op04_rules.good_documents(docs, ones.limit(0)).count() == len(ODD)


def test_statistics_by_hand():
    row = dict(zip(op04_rules.STATISTICS, op04_rules.statistics(["Ab cd cd\nAb cd cd\né 12!", ""])[0], strict=True))
    assert row["chars"] == 23 and row["words"] == 8 and row["lines"] == 3
    assert abs(row["digit_share"] - 2 / 23) < 1e-12 and abs(row["line_repeat_share"] - 1 / 3) < 1e-12
    assert row["exclaims_a_word"] == 1 / 8 and row["repeat_share"] == 2 / 8 and row["distinct_share"] == 4 / 8
    assert abs(row["space_share"] - 7 / 23) < 1e-12
    assert op04_rules.statistics([""])[0][:2].tolist() == [0, 0]


def test_rules_come_from_tree_paths_and_compile_to_columns(spark):
    printed = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 1 <= 3.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 1 > 3.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= -1.0E-3)
     Predict: 0.0
    Else (feature 0 > -1.0E-3)
     Predict: 1.0
"""
    assert op04_rules.tree_paths(printed) == sorted([((1, "<=", 3.5),), ((1, "<=", 2.0),), ((1, "<=", 3.5), (1, ">", 2.0)), ((1, ">", 3.5),), ((0, "<=", -1e-3),), ((0, ">", -1e-3),)])
    rules = [(2.0, ((0, "<=", 5.0), (1, ">", 1.0))), (-1.0, ((1, ">", 3.0),))]
    df = spark.createDataFrame([(float(a), float(b)) for a in (4, 5, 6) for b in (1, 2, 4)], op04_rules.COLUMNS[:2])
    for r in df.withColumn("s", op04_rules.score_column(0.25, rules)).collect():
        z = 0.25 + 2.0 * (r[0] <= 5 and r[1] > 1) - (r[1] > 3)
        assert abs(r["s"] - 1 / (1 + np.exp(-z))) < 1e-12


# 8: language


def test_language_of_held_out_documents(spark):
    rows = registry.queries()["op8_language_id"](spark, LARGER).collect()
    said = {r["doc_id"]: r for r in documents(spark, LARGER).collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(said)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r["lang_pred"] == said[r["doc_id"]]["lang"] for r in rows if r["held_out"] and any(c.isalpha() for c in said[r["doc_id"]]["text"])]
    assert len(judged) > 250 and sum(judged) / len(judged) >= 0.95, sum(judged) / len(judged)


LEARNED = [
    (1, "the quick brown fox jumps over the lazy dog and then the other one runs with them through the woods", "en"),
    (2, "der schnelle braune fuchs springt und dann läuft der andere mit ihnen durch den wald zwischen den bäumen", "de"),
    (3, "быстрая коричневая лиса прыгает через ленивую собаку и потом бежит", "ru"),
    (4, None, "fr"), (5, "nothing is said of this", None),
]


def small_model(spark):
    return op08_language.learn(spark.createDataFrame(LEARNED, "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(spark):
    model = small_model(spark)
    assert model.languages == ["de", "en", "ru"]
    parts = ["the other dog runs with them through the woods", "der andere läuft durch den wald mit den bäumen", "лиса прыгает через собаку"]
    text, at, want = " / ".join(parts), 0, []
    for part, lang in zip(parts, ("en", "de", "ru"), strict=True):
        want.append((at, at + len(part), lang))
        at += len(part) + 3
    assert op08_language.spans(text, model) == want
    assert op08_language.spans("12 !", model) == []
    texts = ["", text, None, "12", parts[1], text + "\n" + parts[0], " \U00020000 " + parts[2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op08_language.identify(docs, model, with_spans=True).collect():  # texts of one batch as each by itself
        assert list(zip(r["span_start"], r["span_end"], r["span_lang"], strict=True)) == op08_language.spans(texts[r["doc_id"]] or "", model)


def test_spans_of_the_query(spark):
    said = {r["doc_id"]: r["text"] for r in documents(spark, LARGER).collect()}
    for r in registry.queries()["op8_language_id"](spark, LARGER).collect():
        cut = [(*map(int, x.split(":")[0].split("-")), x.split(":")[1]) for x in r["spans"].split()]
        assert len(cut) == r["n_spans"] and all(a[1] <= b[0] and a[2] != b[2] for a, b in zip(cut, cut[1:], strict=False))
        letters = {}
        for a, z, lang in cut:
            assert said[r["doc_id"]][a].isalpha() and said[r["doc_id"]][z - 1].isalpha()
            letters[lang] = letters.get(lang, 0) + sum(c.isalpha() for c in said[r["doc_id"]][a:z])
        assert sum(letters.values()) == sum(c.isalpha() for c in said[r["doc_id"]] or "")
        top = max(letters, key=lambda x: (letters[x], x == r["lang_pred"]), default="und")
        assert top == r["lang_pred"] and abs(r["score"] - letters.get(top, 0) / max(1, sum(letters.values()))) < 1e-9


def test_scripts_narrow_the_candidates(spark):
    model = small_model(spark)
    scores = op08_language.word_scores(op08_language.words_of(["dog собака"]), model)
    assert (scores[0] > -1e3).tolist() == [True, True, False] and (scores[1] > -1e3).tolist() == [False, False, True]


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(1)
    counts = np.array([4, 0, 1, 6, 3])
    scores = r.normal(0, 4, (counts.sum(), 3)).astype(np.float32)
    path = op08_language.viterbi(scores, counts, switch=3.0)
    total = lambda own, p: sum(own[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    at = 0
    for n in counts:
        own, mine = scores[at : at + n], path[at : at + n].tolist()
        best = max((total(own, p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(total(own, mine) - best) < 1e-3
        at += n


def test_language_of_odd_rows(spark):
    model = small_model(spark)
    found = op08_language.identify(odd_docs(spark), model, with_spans=True).collect()
    texts = dict(ODD)
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ODD)
    for r in found:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (r["score"] > 0) == letters
    assert op08_language.identify(no_docs(spark), model).count() == 0
    nothing = op08_language.learn(no_docs(spark))
    assert {r["lang_pred"] for r in op08_language.identify(odd_docs(spark), nothing).collect()} == {"und"}
    kept = op08_language.in_one_language(odd_docs(spark), model, 0.5)
    assert same_rows_left(kept, odd_docs(spark)) and {2, 3, 7}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_letters_of_every_plane_and_many_languages(spark):
    high = chr(0x32100) * 4
    rows = [(i, f"{chr(0x4E00 + 7 * i) * 6}", f"l{i:03}") for i in range(300)] + [(999, high, "high")]
    model = op08_language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 301
    found, share, *_ = op08_language.predict([high, rows[290][1], rows[3][1], "12"], model)
    assert found == ["high", "l290", "l003", "und"] and share.tolist() == [1, 1, 1, 0]


def test_equal_ids_with_several_texts_are_learned_from_alike(spark):
    docs = made_docs(spark)
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" MORE!!"))))
    labels = small_labels(spark, docs)
    kept = [counted(r[:2] for r in op04_rules.good_documents(x, labels).select("doc_id", "text").collect()) for x in (twice, twice.repartition(7, "text"), twice.orderBy(F.desc("text")))]
    assert kept[0] == kept[1] == kept[2]


def test_held_out_texts_are_not_learned(spark):
    docs = odd_docs(spark, [(i, f"word{'abcdef'[i % 6]} more") for i in range(30)])
    assert sorted(r["doc_id"] for r in op08_language.learned_fold(docs).collect()) == [i for i in range(30) if not held_out(i)]
