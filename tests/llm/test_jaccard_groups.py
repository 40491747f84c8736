import random

from casebook.llm import jaccard


def test_near_copies_that_share_a_few_shingles_with_the_leader_are_no_groups_of_their_own(spark):
    # 300 classes hold the same five prefix shingles (least is 8), and each one more pair by pair
    rows = [(t, c, 100, 0) for c in range(300) for t in range(5)] + [(1000 + c // 2, c, 100, c // 2 * 2) for c in range(300)]
    shared = spark.createDataFrame(rows, "token long, cid long, n int, leader long")
    groups = jaccard.grouped(shared, 80, 100)
    assert groups.count() == 300 and groups.select("gid").distinct().count() <= 4
    pairs = jaccard.candidate_pairs(shared, groups, 80)
    assert pairs.count() <= 4 * 5 // 2


def test_coarser_groups_lose_no_link(spark):
    rnd = random.Random(5)
    base, texts = [f"w{i}" for i in range(60)], []
    for _ in range(120):  # near copies, a few words changed, and some cut to a part
        words = [f"x{rnd.randrange(400)}" if rnd.random() < 0.04 else w for w in base]
        texts.append(" ".join(words[:rnd.choice((60, 60, 45, 30, 20))]))
    texts += [" ".join(f"y{rnd.randrange(3000)}" for _ in range(30)) for _ in range(20)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (8, 256):
        got = jaccard.jaccard_components(docs, size=5, percent=80, group_size=size)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(root))
