import numpy as np
import pytest

from pairlab.functions.vectors import euclid_rows
from pairlab.operators.losses import bidirectional_loss, dot_matrix, in_batch_row_losses, one_way_loss


def _setup(spark):
    qv = spark.createDataFrame([
        (0, "q0", [1.0, 0.0]), (1, "q1", [0.0, 1.0]), (2, "hq0", [0.6, 0.8]), (3, "hq1", [0.8, 0.6])],
        "corpus_id long, text string, embedding array<double>")
    cv = spark.createDataFrame([
        (0, "c0", [0.8, 0.6]), (1, "c1", [0.0, 1.0]), (2, "hc0", [0.6, 0.8]), (3, "hc1", [-1.0, 0.0])],
        "corpus_id long, text string, embedding array<double>")
    batched = spark.createDataFrame([
        (0, 0, ["q0", "hq0", "c0", "hc0"]), (0, 1, ["q1", "hq1", "c1", "hc1"])],
        "batch_id long, pos int, texts array<string>")
    return qv, cv, batched


@pytest.mark.parametrize("scale,fwd,bwd,loss", [
    (20.0, [0.01815004, 0.0184793], [4.38388735, 0.0184793], 1.109748999624169),
    (1.0, [0.88927245, 1.04974771], [1.43832792, 1.04974771], 1.1067739447752387),
])
def test_bidirectional_golden(spark, scale, fwd, bwd, loss):
    qv, cv, batched = _setup(spark)
    rows = {r.pos: r for r in in_batch_row_losses(batched, qv, cv, 1, scale).collect()}
    for i in range(2):
        assert rows[i].forward == pytest.approx(fwd[i], abs=1e-7)
        assert rows[i].backward == pytest.approx(bwd[i], abs=1e-7)
    got = bidirectional_loss(batched, qv, cv, 1, scale).collect()[0]
    assert got.loss == pytest.approx(loss, abs=1e-12)


@pytest.mark.parametrize("scale,expected", [(20.0, 0.018314671523484094), (1.0, 0.9695100755247377)])
def test_one_way_golden(spark, scale, expected):
    qv, cv, batched = _setup(spark)
    # A7 = forward half with Hq = 0: anchors are the true queries only, candidates [c, hc]
    one = batched.selectExpr("batch_id", "pos", "array(texts[0], texts[2], texts[3]) AS texts")
    got = one_way_loss(one, qv, cv, scale).collect()[0]
    assert got.loss == pytest.approx(expected, abs=1e-12)


def test_similarity_of_the_losses_is_a_parameter(spark):
    qv, cv, batched = _setup(spark)
    doubled = cv.selectExpr("corpus_id", "text", "transform(embedding, x -> 2 * x) AS embedding")
    rows = {r.pos: r for r in in_batch_row_losses(batched, qv, doubled, 1, 1.0, dot_matrix).collect()}
    q = np.array([[1.0, 0.0], [0.0, 1.0]])
    c = 2 * np.array([[0.8, 0.6], [0.0, 1.0], [0.6, 0.8], [-1.0, 0.0]])
    s = q @ c.T
    for i in range(2):
        assert rows[i].forward == pytest.approx(np.log(np.exp(s[i]).sum()) - s[i, i], abs=1e-12)


def test_euclid_rows(spark):
    df = spark.createDataFrame([(0, [0.0, 3.0], [4.0, 0.0]), (1, None, [1.0, 2.0]), (2, [1.0], [1.0, 2.0]),
                                (3, [1.0], [1.0])], "k int, a array<double>, b array<double>")
    got = {r.k: r.d for r in df.select("k", euclid_rows("a", "b").alias("d")).collect()}
    assert got == {0: 5.0, 1: None, 2: None, 3: 0.0}
