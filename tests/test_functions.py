import difflib
import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import scoring as S
from brindle.functions import text as X
from brindle.operators.search import sequence_ratio


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("src/services/authService.ts", "src/services/*Service.ts"),
        ("src/components/LoginForm.tsx", "src/components/*Form.tsx"),
        ("a/date-helper.js", "a/*-helper.js"),
        ("a/user_model.py", "a/*_model.py"),
        ("main.go", "./*.go"),
        ("a/.env", "a/*"),
        ("x/My-fileName.b", "x/*Name.b"),
    ],
)
def test_generalize(spark, path, want):
    assert value(spark, X.generalize(F.lit(path))) == want


def test_keywords_and_domains(spark):
    assert value(spark, X.path_keywords(F.lit("src/services/authService.ts"))) == ["authservice", "services"]
    assert value(spark, X.domain(F.lit("src/services/authService.ts"))) == "auth"
    assert value(spark, X.domain(F.lit("zzz"))) == "general"
    assert value(spark, X.tokens(F.lit("Find THE user_model-file of it"))) == ["find", "user", "model", "file"]
    assert value(spark, X.query_tokens(F.lit("the of"))) == ["the", "of"]
    assert value(spark, X.category(F.lit("docker_run"), F.lit(None).cast("string"))) == "containers"
    assert value(spark, X.category(F.lit("zz"), F.lit("nothing"))) == "other"
    assert value(spark, X.layer(F.lit("internal/sales/domain/x.go"), "bounded_context")) == "domain"
    assert value(spark, X.context_name(F.lit("internal/sales/domain/*.go"), "bounded_context")) == "internal/{name}/domain/*.go"


def test_hashes_and_texts(spark):
    import hashlib

    assert value(spark, X.change_hash(F.lit("d"), F.lit("{}"))) == hashlib.sha1(b"d\n{}").hexdigest()
    assert value(spark, X.short_hash(F.lit("x"))) == hashlib.sha256(b"x").hexdigest()[:16]
    assert value(spark, X.tail_path(F.lit("p" * 70))) == "..." + "p" * 57
    assert [value(spark, X.duration_seconds(F.lit(t))) for t in ("90d", "4w", "48h", "soon", "")] == [7776000, 2419200, 172800, None, None]
    assert value(spark, X.cut_lines(F.lit("a\n" * 2000))) == ("a\n" * 1485).rstrip("\n")


def test_scores(spark):
    series = [value(spark, S.confidence(F.lit(n))) for n in range(1, 6)]
    assert series == pytest.approx([0.285, 0.4845, 0.6242, 0.7219, 0.7903], abs=1e-4)
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert math.isclose(value(spark, S.cosine(a, b)), 1 / math.sqrt(2))
    assert value(spark, S.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert value(spark, S.cosine(a, F.array(F.lit(1.0)))) == 0
    now = F.lit("2024-02-01 00:00:02").cast("timestamp_ntz")
    late = F.lit("2024-01-31 23:59:59").cast("timestamp_ntz")
    assert value(spark, S.whole_days(late, now)) == 0
    gone = F.lit(None).cast("timestamp_ntz")
    assert value(spark, S.recency(gone, now)) == 0 and value(spark, S.decay(gone, now)) == 1
    for target, want in (("src/a/xService.ts", 1.0), ("src/a/y.ts", 0.7), ("src/b/y.ts", 0.4), ("lib/y.ts", 0.0)):
        assert value(spark, S.path_match(F.lit(target), F.lit("src/a/*Service.ts"))) == want


def test_sequence_ratio(spark):
    got = spark.createDataFrame([("find tool", "tool_find"), (None, "x")], "a string, b string").select(sequence_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in got] == [difflib.SequenceMatcher(None, "find tool", "tool_find").ratio(), 0.0]
