"""Files of the stored corpus and the tasks that read them."""

from __future__ import annotations

from parlance.sources import corpus as C


def test_files_of_the_corpus_do_not_grow_with_it():
    assert C.files_of(1_500, 48) == 1 and C.files_of(150_000, 48) == 48
    for n in (10_000_000, 54_000_000):
        assert n / C.files_of(n, 48) <= C.MOST_DIALOGUES_PER_FILE
