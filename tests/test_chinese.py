"""Segmentation against matches by hand, sounds, and query plans against a direct computation."""

import itertools
import random

import pytest

from loomquery.operators import chinese
from loomquery.operators.chinese import Automaton, Lexicon

WORDS = {"微信": ["wechat"], "支付": ["payment", "pay"], "订单": ["order"], "超时": ["timeout", "expired"], "取消": ["cancel"], "验签": ["verify"], "回调": ["callback", "webhook"], "退款": ["refund"], "测试": ["test"]}
SOUNDS = {"微": "wei", "信": "xin", "威": "wei", "支": "zhi", "付": "fu", "知": "zhi", "订": "ding", "单": "dan", "定": "ding", "超": "chao", "时": "shi", "取": "qu", "消": "xiao", "退": "tui", "款": "kuan", "测": "ce", "试": "shi"}
SYNONYMS = [("支付", "付款"), ("付款", "支付"), ("取消", "撤单"), ("取消", "撤销"), ("订单", "测试")]
STOP = ["如何", "处理", "与", "的", "怎么办"]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    return Lexicon(
        rows([("失败",), ("自动",)], "word string"), rows([(w,) for w in STOP], "word string"), rows([("定单", "订单", 0), ("撤消", "撤销", 1)], "typo string, word string, ordinal int"),
        rows(list(SOUNDS.items()), "char string, sound string"), rows([(a, b, i) for i, (a, b) in enumerate(SYNONYMS)], "word string, peer string, ordinal int"),
        rows([(w, e, i, j) for i, (w, es) in enumerate(WORDS.items()) for j, e in enumerate(es)], "word string, english string, place int, ordinal int"),
    )


@pytest.fixture(scope="module")
def tries(lexicon):
    return chinese.automaton(lexicon)


def test_words_of_sentences(tries):
    assert tries.segment("如何处理微信支付回调验签失败与订单超时自动取消") == (["微信", "支付", "回调", "验签", "失败", "订单", "超时", "自动", "取消"], ["如何处理微信支付回调验签失败与订单超时自动取消"])
    assert tries.segment("威信知付, 定单x撤消")[0] == ["微信", "支付", "订单", "撤销"]  # by sound, by table
    assert tries.segment("微信微信 abc 龙凤的虎豹") == (["微信", "龙凤", "虎豹"], ["微信微信", "龙凤的虎豹"])
    assert tries.segment("怎么办") == ([], []) and tries.segment(None) == ([], []) and tries.segment("单") == ([], [])
    assert tries.sound("订单") == "dingdan" and tries.sound("订") is None and tries.sound("龙凤") is None


def test_longest_matches_by_hand():
    """Every text of up to seven of three characters, over random lexicons: greedy from either end, fewer singles, then from the end."""
    rng, chars = random.Random(2), "甲乙丙"
    every = ["".join(x) for n in (2, 3, 4, 5) for x in itertools.product(chars, repeat=n)]
    for _ in range(6):
        known = frozenset(rng.sample(every, 12))
        tries, reach = Automaton(frozenset("丁"), [], {}, {}, known, 5), 5
        for _ in range(300):
            text = "".join(rng.choice(chars + "丁") for _ in range(rng.randint(2, 9)))

            def greedy(text, back):
                out = []
                while text:
                    n = next((n for n in range(min(reach, len(text)), 1, -1) if (text[-n:] if back else text[:n]) in known), 1)
                    out.append(text[-n:] if back else text[:n])
                    text = text[:-n] if back else text[n:]
                return out[::-1] if back else out

            ahead, back = greedy(text, False), greedy(text, True)
            chosen = back if sum(len(t) == 1 for t in back) <= sum(len(t) == 1 for t in ahead) else ahead
            marked = "".join("|" if t == "丁" else t if len(t) == 1 else f"|{t}|" for t in chosen)
            assert tries.segment(text)[0] == list(dict.fromkeys(w for w in marked.split("|") if len(w) > 1))


def test_query_plans(spark, lexicon, tries):
    queries = [(1, "取消订单 for payment"), (2, "dingdan timeout specs"), (3, "支付 支付"), (4, None), (5, "refund_order"), (6, "订单")]
    got = {}
    for r in chinese.query_plan(spark.createDataFrame(queries, "id int, text string"), lexicon, tries).orderBy("id", "kind", "rank").collect():
        got.setdefault((r["id"], r["kind"]), []).append(r["token"])
    assert got[1, "chinese"] == ["取消", "订单", "支付", "撤单", "撤销", "测试", "付款"]  # own, meant, synonyms in the order of words
    assert got[1, "english"] == ["payment", "zhifu", "quxiao", "cancel", "dingdan", "order"]
    assert got[1, "phrase"] == ["取消订单"] and got[1, "identifier"] == ["payment"]
    assert got[2, "chinese"] == ["订单", "超时", "测试"] and got[2, "english"][:3] == ["dingdan", "timeout", "specs"] and got[2, "english"][-1] == "order" and got[2, "tests"] == ["tests"]
    assert got[3, "english"] == ["zhifu", "payment", "pay"] and got[3, "stem"][0] == "zhifu"
    assert got[5, "chinese"] == ["退款", "订单", "测试"] and (6, "tests") in got and (4, "english") not in got
    tokens = {tuple(r) for r in chinese.concept_tokens(spark.createDataFrame([(1, "微信 payments of it"), (2, None)], "id int, text string"), lexicon, tries).collect()}
    assert tokens == {(1, "微信"), (1, "weixin"), (1, "payments"), (1, "pay")}


def test_large_lexicons_fail(lexicon, spark, monkeypatch):
    monkeypatch.setattr(chinese, "LEXICON_BYTES", 100)
    with pytest.raises(ValueError, match="at most"):
        chinese.automaton(lexicon)


def test_long_texts(tries):
    assert len(tries.segment("微信龙" * 100_000)[0]) == 1
    assert tries.segment("龙" * 100_000)[0] == ["龙" * 100_000]
