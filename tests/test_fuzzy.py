"""Name similarity: exact ratio, and the prefix-filter candidate join loses no match."""

import difflib
import itertools

from pyspark.sql import functions as F

from collections import Counter

from paddock.functions.similarity import char_tokens, min_overlap, prefix_of, ratio
from paddock.operators import fuzzy as FZ
from paddock.plans.context import Context


def test_ratio_is_difflib_on_lower_case():
    assert ratio("EUROPE Premier Yearling Sale 1998", "europe premier yearling sale") == \
        difflib.SequenceMatcher(None, "europe premier yearling sale 1998", "europe premier yearling sale").ratio()


def test_prefix_filter_never_misses_a_pair():
    words = ["Premier Yearling Sale", "Premier Yearling Sale 1998", "Autumn Classic", "Autumn Classic Book 2",
             "Showcase Auction", "Winter Mixed Bloodstock", "Classic Yearling", "premier yearling", "aaaa", "aaab",
             "abab", "baba", "", "Yearling Sale Premier", "Gold Coast Book 1", "Gold Coast Book 2", "Coast Gold"]
    freq = Counter(t for w in set(x.lower() for x in words) for t in set(char_tokens(w)))
    for a, b in itertools.product(words, repeat=2):
        if ratio(a, b) >= 0.75:
            assert set(prefix_of(a, 0.75, freq)) & set(prefix_of(b, 0.75, freq)), (a, b)


def test_min_overlap():
    assert min_overlap(10, 0.75) == 6 and min_overlap(5, 0.75) == 3


def test_matches_equal_brute_force(spark):
    from conftest import SF_SMALL
    c = Context.of(spark, "/root/testdata/sf0.01")
    sales = c.t("sales")
    got = {(r["sale_id"], r["match_sale_id"]) for r in FZ.matches(sales, 1, 5, "fuzzy", 0.75).collect()}
    rows = sales.select("sale_id", "company_id", F.year("start_date").alias("y"), "sale_name").collect()
    want = set()
    for a in rows:                       # brute force over all pairs on a small fixture only
        for b in rows:
            if (a["company_id"] == b["company_id"] and a["y"] - 5 <= b["y"] <= a["y"] - 1
                    and a["sale_id"] != b["sale_id"] and ratio(a["sale_name"], b["sale_name"]) >= 0.75):
                want.add((a["sale_id"], b["sale_id"]))
    assert got == want and len(want) > 0
    assert SF_SMALL
