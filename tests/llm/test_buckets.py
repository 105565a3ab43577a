"""Anchors are dealt evenly, however many buckets there are."""

import numpy as np

from arcwise.llm import suffix_dedup as S


def test_buckets_are_even():
    text = np.random.default_rng(1).integers(97, 123, 1 << 20).astype("u1")
    at, keys = S.anchors(text, np.array([len(text)]))
    for n in (3, 61):
        many = np.bincount(S._buckets(keys, n), minlength=n)
        assert many.max() < 1.5 * many.mean()
    assert len(np.unique(keys)) == len(np.unique(S.key_hashes(text)[at]))
