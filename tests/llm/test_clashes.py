"""User columns called like anything that the operators use inside, in either case, are kept as they are."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm import exact_dedup, quality, secrets, simhash

FOLDER = Path(simhash.__file__).parent
#: Every name of a column that any module of the subpackage gives, and its sort of name.
INSIDE = sorted({n for f in FOLDER.glob("*.py") for n in re.findall(r"""(?:alias|withColumn|withColumnRenamed|toDF)\(\s*(?:"[^"]*",\s*)?"(\w+)\"""", f.read_text())} | {"__h", "__maybe", "__lost", "__block", "__bits", "__id", "__clean", "__words", "__rid", "rid", "row", "norm", "suspect", "clean", "c0", "c7", "f", "id"})
WORDS = "\n".join(" ".join("the" if i % 4 == 0 else "w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(start, start + 25)) for start in range(0, 100, 25))


@pytest.fixture(scope="module", params=[str.lower, str.upper], ids=["lower", "upper"])
def clashing(spark, request):
    names = [request.param(n) for n in {n.lower() for n in INSIDE} - {"doc_id", "text", "lang", "source", "n_chars"}]
    texts = [(1, WORDS), (2, WORDS), (3, WORDS.replace("wgb ", "wgbx ")), (4, "short password=hunter22"), (5, None), (6, WORDS.replace("w", "q") + " password=hunter22"), (None, "none")]
    docs = spark.createDataFrame([(i, t, None, "s", 7) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in names]).coalesce(1).cache()


WORK = {
    "drop_near_copies": simhash.drop_near_copies,
    **{f"stage {label}": lambda docs, stage=stage: stage(docs.sparkSession, docs, "") for label, stage in corpus_pipeline.STAGES[:-1]},
}


@pytest.mark.parametrize("label", list(WORK))
def test_columns_of_any_name_are_kept(clashing, label):
    out = WORK[label](clashing)
    assert out.columns == clashing.columns
    own = [c for c in clashing.columns if c not in ("text", "n_chars")]
    before = {tuple(r[c] for c in own) for r in clashing.collect()}
    after = [tuple(r[c] for c in own) for r in out.collect()]
    assert len(after) == len(set(after)) and set(after) <= before and after
    if label == "stage secrets":
        assert len(after) == len(before)


def test_operators_that_read_two_columns_take_any_others(spark, clashing):
    from ledgerframe.llm import licenses, packing, toxicity
    from ledgerframe.llm.queries import vocabulary_path

    n = clashing.count()
    assert exact_dedup.exact_dedup(clashing).count() == simhash.simhash_groups(clashing).count() == n
    assert quality.judge(clashing).count() == secrets.find_secrets(clashing).count() == licenses.scan_licenses(clashing).count() == n
    assert toxicity.score_toxicity(clashing, toxicity.Lexicon(())).count() == n
    assert packing.pack(clashing, vocabulary_path()).count() >= n
