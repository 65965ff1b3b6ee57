"""The pipeline's stages on a small table, against what each should decide."""

import corpus_pipeline
from tessera.llm import mixing, near_dedup
from tests.llm.test_models import DE, EN, brute_classes, prose


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(9)
    texts = [prose(rng, EN if i % 2 else DE, rng.randint(30, 90)) for i in range(150)]
    texts += [texts[3], texts[3].replace(" ", "\n"), " ".join([*texts[5].split(), "extra"]), None, "", "12 34"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: sorted(r.doc_id for r in v) for k, v in seen.items()}
    assert ids["language_id"] == list(range(153))
    assert ids["exact_copies"] == [i for i in range(153) if i not in (150, 151)]
    classes = brute_classes([texts[i] for i in ids["exact_copies"]])
    assert ids["near_copies"] == sorted({ids["exact_copies"][c] for c in classes.values()}) and 152 not in ids["near_copies"]
    near = [r for r in seen["near_copies"]]
    size = sum(len(r.text.split()) for r in near)
    mixed = sum(len(r.text.split()) for r in seen["mix_sources"])
    assert abs(mixed - 1.5 * size) < 0.1 * size + 4 * mixing.BLOCK_WORDS
    assert set(ids["mix_sources"]) <= set(ids["near_copies"]) and len(ids["tokens"]) == len(ids["mix_sources"])
    assert near_dedup.THRESHOLD == 0.8


CLASH = ("row", "key", "stay", "nth", "copies", "size", "taken", "spans", "name", "cell", "of", "at", "lang_pred", "score", "read", "readable", "id", "node", "comp", "digest", "sha", "h", "pass", "new", "words", "h a.b")


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    extra = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *[f"{c}{i}" for c in CLASH]) for i, t, lang, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def test_stages_on_odd_rows(spark, tmp_path):
    import random

    rng = random.Random(14)
    base = [(i, prose(rng, EN if i % 2 else DE, 40), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    odd = [(None, base[1][1], "en", "s1"), (None, base[1][1], "en", "s1"), (3, base[3][1], "en", None), (3, base[3][1], "en", None), (3, base[5][1] + " and more", "en", "s2"), (70, None, None, None), (71, "", "en", "s0"), (72, " \n", "de", "s1"), (73, "42 !!", "de", "s1")]
    docs = frame(spark, base + odd)
    want = {"language_id": 65, "exact_copies": 63, "near_copies": None, "mix_sources": None}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "tokens":
            assert len(rows) == len(base + odd) and {r.n_tokens for r in rows if r.doc_id in (70, 71)} == {1}
            continue
        assert out.columns == docs.columns and all(r["h a.b"] == f"h a.b{r.doc_id}" and r.row == f"row{r.doc_id}" for r in rows)
        texts = [r.text for r in rows]
        if name == "language_id":
            # Without a letter, a document goes; all others stay, repeated ones too.
            assert len(rows) == want[name] and not {70, 71, 72, 73} & {r.doc_id for r in rows}
        elif name == "exact_copies":
            assert sorted(t for t in texts if t and t.strip()) == sorted({t for _, t, _, _ in base + odd if t and t.strip()}) and [t for t in texts if not (t or "").strip()] == [" \n"]
        elif name == "near_copies":
            assert sum(t == base[1][1] for t in texts) == 1 and sum(t == base[3][1] for t in texts) == 1
            assert sum(not (t or "").strip() for t in texts) == 3  # documents without words stay
        else:
            assert all(t.strip() for t in texts) and {r.doc_id for r in rows} - {None} <= {i for i, *_ in base + odd}


def test_stages_on_empty_tables(spark, tmp_path):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)
