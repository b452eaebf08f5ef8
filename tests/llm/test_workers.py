"""What Python workers keep between tasks."""

import os
import uuid
from collections import Counter

from helpers import documents

from millrace.llm import common, packing


def test_a_worker_makes_its_encoder_once(spark, tmp_path):
    """However many tasks it runs: each encoder takes some 50 MB and seconds to make."""

    def path_of(name):
        (tmp_path / f"{os.getpid()}-{uuid.uuid4()}").touch()
        return packing._public_path(name)

    docs = documents(spark, [(i, f"text {i}", "en", "s", 6) for i in range(64)]).repartition(16)
    assert packing.pieces(docs, "byte_bpe_50k.json", 2, 1024, path_of).count() == 64
    made = Counter(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert made and set(made.values()) == {1}


def test_a_worker_keeps_one_thing():
    a = common.held("a", 1, list)
    assert common.held("a", 1, list) is a
    common.held("b", 1, list)
    assert list(common._held) == [("b", 1)] and common.held("a", 1, list) is not a


def test_special_strings_are_the_librarys():
    made = packing.encoder("byte_bpe_50k.json", packing._public_path)
    assert "library" not in vars(made)
    text = "one<|endoftext|> two"
    assert made.encode(text) and "library" in vars(made)
    assert made.special == [t.content for t in made.library.get_added_tokens_decoder().values()]
