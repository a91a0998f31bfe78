"""Phrases fail a line only as whole words that make up most of it; braces only as a share of it."""

import pytest

from oddsloom.llm import quality

PROSE = [
    "The firm took part in the design in the north.", "She wrote about it on her blog in the spring.", "You will find it in the catalog in the hall.",
    "They were empowered by the new law of the land.", "Anyone can read more about this war in the last chapter.", "We share this view with most of our friends.",
    "Copyright was not known to the poets of that age.", "Nobody in the whole office reads the terms of service.", "He wanted to sign in before the others came.",
    "The set {a, b} has two members and no more.", "My sister has learned JavaScript and two other languages since.",
]
BOILERPLATE = [
    "All rights reserved.", "Copyright 2019 Acme Inc. All rights reserved.", "Copyright © 2019", "Read more", "Sign in", "Log in to your account", "Sign in | Sign up",
    "Powered by WordPress", "Please enable JavaScript to view this page.", "This site uses cookies to improve your experience.", "Privacy Policy | Terms of Use",
    "Share this article on Twitter", "Click here to subscribe", "Skip to main content", "SUBSCRIBE TO OUR NEWSLETTER", "404 page not found",
    "if (x) { return 1 }", ".btn { color: red }", "function f() { var x = 1; return x; }", '{"name": "value", "list": [1, 2]}',
]


@pytest.mark.parametrize("line", PROSE)
def test_prose_stays(line):
    assert quality.fault(line, set()) is None


@pytest.mark.parametrize("line", BOILERPLATE)
def test_boilerplate_goes(line):
    assert quality.fault(line, set()) == "boilerplate"


def test_clean_documents_stay_whole():
    long = "It was a day like any other and the people of the town went about their work as they had always done. " * 20 + "Let {x} be one of them."
    for text in (long, "The firm took part in the design in the north.\nNobody knew who had paid for it."):
        assert quality.clean(text) == (text, True)
