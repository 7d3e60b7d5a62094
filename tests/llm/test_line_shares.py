"""Tokens are dealt into shares that are shuffled one after another; lines are judged the same by any number of them."""

from factloom.llm import line_dedup


def test_shares_of_tokens_change_nothing(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join(words[i % 7 : i % 7 + 20] + ([f"own{i}"] if i % 3 else [])) for i in range(60)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 3])) for i in range(50)], "doc_id long, text string")
    seen, members = [], line_dedup._members

    def watched(firsts, part, num, den):
        seen.append(part)
        return members(firsts, part, num, den)

    monkeypatch.setattr(line_dedup, "_members", watched)
    found = []
    for parts in (1, 5):
        monkeypatch.setattr(line_dedup, "PARTS", parts)
        found.append(sorted(map(tuple, line_dedup.dedup_lines(docs, width=2).collect())))
    assert seen == [0, 0, 1, 2, 3, 4]
    assert found[0] == found[1] and any(not row[3] for row in found[0])
