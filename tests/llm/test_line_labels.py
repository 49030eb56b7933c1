import numpy as np

from leadflow.llm import quality


def test_lines_that_differ_from_their_document_are_found():
    """Good documents are prose; bad ones are junk with a stretch of prose, which the chain tells apart."""
    prose = [f"The river ran low that {d}, and the mill stood still for a while." for d in ("morning", "week", "summer", "year", "night")]
    junk = [f"$$$ BUY {i * 37 % 91} NOW >>> {'#' * (i % 5 + 3)} {i * 7919 % 9973} @@" for i in range(40)]
    texts = ["\n".join(prose[i % 5 :] + prose[: i % 5]) for i in range(60)]
    mixed = ["\n".join(junk[i % 30 : i % 30 + 4] + prose[:3] + junk[i % 25 : i % 25 + 4]) for i in range(60)]
    lines = quality.line_features(texts + mixed)
    model = quality.train(lines, np.array([True] * 60 + [False] * 60))
    p = model.marginals(lines)
    inside = p[300:].reshape(60, 11)  # prose lines of mixed documents, but for those beside junk, and junk lines
    assert (p[:300] > 0.5).all() and inside[:, 5].mean() > 0.5 > inside[:, [0, 1, 2, 9, 10]].max()
    assert (model.score(lines)[:60] > 0.5).all() and (model.score(lines)[60:] < 0.5).all()
    alone = model.change[0, 0] + model.change[1, 1] - model.change[0, 1] - model.change[1, 0]
    assert 0 < alone < 12  # staying is likelier, and changes were seen: no weight stands at its bound


def test_less_than_half_of_a_document_changes():
    size, counts = np.array([10.0, 10, 10, 10, 0, 30]), np.array([4, 1, 1])
    good = np.array([True, False, True])
    got = quality.line_labels(good, size, counts, np.array([0.01, 0.05, 0.02, 0.95, 0.99, 0.5]))
    assert got.tolist() == [0, 1, 1, 1, 0, 1]  # a second line would make it half; a lone line keeps its label


def test_a_fit_is_bounded_in_lines(spark):
    docs = spark.createDataFrame([(i, "\n" * 3000 if i % 5 == 0 else f"Some words of prose, number {i}, stand here.") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels, lines=7000)
    assert np.isfinite(model.weights).all() and np.isfinite([model.slope, model.offset]).all()
    none = quality.fit(docs, labels, lines=0)
    assert none.score(quality.line_features(["x"])).tolist() == [0.5]
