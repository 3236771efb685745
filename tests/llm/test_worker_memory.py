"""A Python worker holds what the operator at work needs, not what all before it needed."""

import gc
import weakref

import public_tokenizers

from fleetlens.llm import language_id, sentencepiece_fst, shingles
from fleetlens.llm.worker_memory import kept


def test_the_next_operator_lets_go_what_the_last_one_kept():
    samples = (("de", "der hund und die katze"), ("en", "the dog and the cat"))
    machine = lambda: sentencepiece_fst.compiled(public_tokenizers.path("piece_bpe_32k.model"))
    parser = weakref.ref(language_id._parser(samples))
    assert language_id._parser(samples) is parser()
    other = weakref.ref(language_id._parser(samples[:1]))
    gc.collect()
    assert parser() is None
    transducer = weakref.ref(machine())
    assert machine() is transducer()
    gc.collect()
    assert other() is None
    before = shingles.shingle_set("the dog and the cat and the dog").tolist()
    gc.collect()
    assert transducer() is None
    assert len(kept("words", dict)) == 4
    assert language_id._parser(samples).judge(["the cat"])[0] == ["en"]
    assert shingles.shingle_set("the dog and the cat and the dog").tolist() == before


def test_a_machine_remembers_bounded_paths_and_keeps_the_frequent_ones(monkeypatch):
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    model = sentencepiece_fst.Model(data)
    texts = [f"the w{i}ord, x{i}-y{i} the end" for i in range(300)]
    free = sentencepiece_fst.Transducer(model)
    expected = [free.encode(t) for t in texts]
    monkeypatch.setattr(sentencepiece_fst, "REMEMBERED_PARTS", 40)
    machine = sentencepiece_fst.Transducer(model)
    for text, path in zip(texts, expected):
        assert machine.encode(text) == path
        held = [x for x in vars(machine).values() if isinstance(x, dict) and any(isinstance(v, bytes) for v in x.values())]
        assert sum(len(x) + len(getattr(x, "old", ())) for x in held) <= 40
    assert {"▁the", "▁end"} <= {*machine.paths, *machine.paths.old}
