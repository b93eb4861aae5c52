"""Rows that the joins of near-duplicate search make, from Spark's own counts, and the pairs that they find."""

import itertools
import random

from tessera.llm import near_dup
from test_texts import distance, edited, words

N_SCHEMA = "node bigint, n int, component bigint"


def near_pairs(spark, texts, component, of=""):
    """Pairs of _near_by_words, and the rows that its largest join (whose description holds `of`) made."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    before = set(ids())
    open_ = spark.createDataFrame([(i, len(t.split()), component(i)) for i, t in texts.items()], N_SCHEMA)
    found = [tuple(r) for r in near_dup._near_by_words(open_, spark.createDataFrame(list(texts.items()), "node bigint, text string"), 0.8).collect()]
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for i in set(ids()) - before:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if "Join" in node.name() and of in node.desc() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return found, most


def test_components_meet_without_all_their_texts(spark):
    """Three hundred texts of one component have words of others' texts: each of these texts meets the component, and only those of its texts that can be near;
    a pair comes once, not once for each word in common."""
    rng = random.Random(41)
    texts = {i: words(rng, 20, 60) for i in range(300)} | {1000 + i: words(rng, 20, 60) for i in range(30)}
    texts |= {2000 + i: edited(rng, texts[i], 0.1) for i in range(10)}
    component = lambda i: 0 if i < 1000 else i
    near = {(i, j) for i, j in itertools.combinations(texts, 2) if component(i) != component(j) and distance(a := texts[i].split(), b := texts[j].split()) <= 0.2 * max(len(a), len(b)) + 1e-9}
    found, most = near_pairs(spark, texts, component, "component")
    assert len(near) >= 5 and near <= set(found)
    assert most < 1.5 * len(found) + len(texts), (most, len(found))


def test_words_are_not_joined(spark):
    """Long texts of common words in any number: no join has a row for each word of each text."""
    rng = random.Random(42)
    texts = {i: words(rng, 400, 3000) for i in range(60)}
    texts |= {100 + i: edited(rng, texts[i], 0.1) for i in range(10)}
    found, most = near_pairs(spark, texts, lambda i: i)
    assert {(i, 100 + i) for i in range(10)} <= set(found)
    assert most < 60 * len(texts), most  # words: about 375 a text
