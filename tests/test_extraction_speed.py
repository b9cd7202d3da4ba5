"""Patterns that a text cannot match are not tried."""

import random
import re
import time

from trellis.operators import extract


def test_needed_words():
    needed = dict((p, extract.needed_words(p)) for p in ("(.+?)的(?:症状|表现)(.+)", "a(?:b|c)?d+", "(?:x|y*)z", "(?i)abc", "[ab]c|d", "(?:ab|.)c", "(?=q)r"))
    assert needed == {
        "(.+?)的(?:症状|表现)(.+)": [("的",), ("症状", "表现")], "a(?:b|c)?d+": [("a",), ("d",)], "(?:x|y*)z": [("z",)], "(?i)abc": [], "[ab]c|d": [("a", "b", "d")],
        "(?:ab|.)c": [("c",)], "(?=q)r": [("r",)],
    }


def test_patterns_find_what_they_did():
    rng = random.Random(5)
    letters = sorted({w for p in extract.RELATION_PATTERNS for words in extract.needed_words(p[0]) for w in words}) + list("的是为有包括会能ab，、\n； ")
    for _ in range(1500):
        text, found = "".join(rng.choice(letters) for _ in range(rng.randrange(12))), {}
        for pattern, relation, head_type, tail_type in extract.RELATION_PATTERNS:
            for m in re.finditer(pattern, text):
                tail = m[2] if len(m.groups()) == 2 else m[3]
                for item in (i.strip() for i in re.split("[,，、;；]", tail.strip())):
                    if item and len(item) <= extract.LONGEST_TAIL:
                        found.setdefault((m[1].strip(), relation, item), (m[1].strip(), relation, item, head_type, tail_type, extract.RULE_SCORE))
        assert extract.relations_in(text) == list(found.values())


def test_texts_without_the_words_are_fast():
    # patterns with two open ends go through all substrings: this took seconds
    began = time.process_time()
    assert extract.relations_in("x" * 400)
    assert time.process_time() - began < 1
