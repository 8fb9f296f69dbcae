"""Tagging rules over the test tables."""

from __future__ import annotations

from ..operators.tagging import rule_set, words

# Rules over the driver's synthetic corpus (invented prose in en/fr/de/es):
# frequent whole words per language, page-host path shapes, and hunk words,
# chosen so that every score combination of the table in FIXTURES 4 occurs.
TEST_RULES = rule_set([
    ("lang-en", "English prose", {"body": [words("that", "with")], "path": [r"/en/"]}),
    ("lang-de", "German prose", {"body": [words("und", "sich")], "path": [r"/de/"],
                                 "hunk": [words("keit")]}),
    ("lang-fr", "French prose", {"body": [words("qui", "une")], "path": [r"/fr/"],
                                 "hunk": [words("eux")]}),
    ("lang-es", "Spanish prose", {"body": [words("los", "para")], "path": [r"/es/"],
                                  "hunk": [words("del")]}),
    ("org-site", "Pages under .org hosts", {"path": [r"\.example\.org/"]}),
    ("mobile", "Mobile hosts", {"path": [r"^m\."], "hunk": [words("the")]}),
    ("hunk-only", "Only a hunk pattern (never tags alone)", {"hunk": [words("the")]}),
    ("spam", "Spam-like hosts and words", {"body": [words("cheap", "pills")],
                                           "path": [r"cheap-pills"]}),
    ("license", "Licence lines", {"body": [words("license", "licensed")],
                                  "hunk": [words("license")]}),
    ("credentials", "Token-like assignments", {"body": [r'token *= *"'],
                                               "hunk": [r"token *="]}),
    ("suffix-tion", "Words ending in -tion", {"body": [words("tion", "ation")],
                                              "path": [r"blog\."], "hunk": [words("tion")]}),
    # "x@y.z" somewhere: written with the shortest prefix/suffix that decides
    # a match, which keeps the regex from re-scanning every word before '@'
    ("contact", "E-mail addresses", {"body": [r"[a-z0-9.]@[a-z0-9.]+\.[a-z]"]}),
])
# Older, smaller rule set: "tags that existed before the rules were extended".
TEST_RULES_OLD = [r for r in TEST_RULES if r.tag in ("lang-en", "lang-de", "spam", "license")]
