import random

import pytest

from lakeloom.llm import split as S


def check(text, limit, overlap):
    found = S.pieces(text, limit, overlap)
    real = max(0, min(overlap, int(limit * S.MOST_OVERLAP))) if limit > 0 else 0
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(found, found[1:], strict=False):
        assert a < c <= b < d and b - c <= real + real // 4
        assert b - c >= real - real // 4 or b - a <= real + real // 4  # a piece repeats no more than there is
    assert all(0 < b - a <= max(limit, 1) or limit <= 0 for a, b, _ in found)
    return found


def test_overlap_is_as_given():
    words = " ".join(f"ord{i}" for i in range(400))
    for limit, overlap in ((300, 200), (300, 20), (1000, 150)):
        found = check(words, limit, overlap)
        assert all(abs(b - c - overlap) <= overlap // 4 for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, "A b c. " * 700, "line of text\n" * 400, "é" * 2500, "\n" * 3000, "word" * 10 + " " * 3000, "One. " + "y" * 4000 + " two. Three."])
@pytest.mark.parametrize(("limit", "overlap"), [(1500, 150), (300, 0), (101, 90), (50, 49), (7, 3), (1, 0)])
def test_cover(text, limit, overlap):
    check(text, limit, overlap)


def test_random():
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "c ", "d. ", "E", "\n", "\n\n", "! ", "æø "]) for _ in range(rng.randrange(1, 500)))
        check(text, rng.randrange(1, 200), rng.randrange(0, 100))


def test_no_limit():
    assert S.pieces("abc", 0, 5) == [(0, 3, "end")] == S.pieces("abc", 3, 1)


def test_topic_change():
    """The cut falls where the words change."""
    a = "The grant pays students monthly money support. " * 12
    b = "Engines burn petrol inside metal cylinders loudly. " * 12
    found = S.pieces(a + b, 700, 0)
    assert found[0][1] == len(a) and found[0][2] == "unit"


def test_depths_equal_recount():
    text = "one two three. two three four. five six seven. six seven eight. nine ten one. two four six. "
    ends = [e for e, _ in S.unit_ends(text)]
    import math
    from collections import Counter

    edges = [0, *ends, len(text)]
    units = [Counter(S._WORD.findall(text[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
    sims = []
    for i in range(1, len(units)):
        left, right = sum(units[max(0, i - S.BLOCK) : i], Counter()), sum(units[i : i + S.BLOCK], Counter())
        sims.append(sum(left[w] * right[w] for w in left) / math.sqrt(sum(x * x for x in left.values()) * sum(x * x for x in right.values())))
    got = S.depths(text, ends)

    def climb(i, step):
        while 0 <= i + step < len(sims) and sims[i + step] >= sims[i]:
            i += step
        return sims[i]

    assert got == pytest.approx([climb(i, -1) + climb(i, 1) - 2 * sims[i] for i in range(len(sims))])


def test_table(spark):
    rows = [(1, "word " * 100, "a"), (1, "word " * 100, "b"), (2, None, "c"), (3, "", "d"), (4, "short", "e"), (None, "z" * 300, "f")]
    df = spark.createDataFrame(rows, "sec_id bigint, content string, n_pieces string")
    conf = spark.createDataFrame([("v1", 200, None), ("v2", 400, 50), ("off", 0, 1), ("none", None, 1), ("v2", 400, 50)], "prompt_version string, max_chars int, overlap_chars int")
    got = S.split_oversized(df, conf).collect()
    assert {(r.sec_id, r.prompt_version) for r in got} == {(1, "v1"), (1, "v2"), (None, "v1")}
    assert len({(r.sec_id, r.prompt_version, r.piece_no) for r in got}) == len(got)
    one = sorted((r for r in got if r.sec_id == 1 and r.prompt_version == "v1"), key=lambda r: r.piece_no)
    assert "".join(r.content for r in one) == "word " * 100 and {r.repeats for r in one} == {0}
    two = sorted((r for r in got if r.sec_id == 1 and r.prompt_version == "v2"), key=lambda r: r.piece_no)
    assert [r.repeats for r in two] == [0, 50] and two[0].content[-50:] == two[1].content[:50]
    assert S.split_oversized(df.limit(0), conf).count() == 0
    assert S.split_oversized(df, conf.limit(0)).count() == 0
