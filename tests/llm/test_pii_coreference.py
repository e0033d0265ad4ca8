"""All mentions of a person or a number get one surrogate."""

import re

import pytest
from test_texts import KEY, docs

from treeflow.llm import pii


def test_names_are_found_again():
    text, kinds = pii.rewrite("Dr John Smith came. Smith said so; John Smith's dog. Smithers and smith stay.", {}, KEY)
    first, last, again, given, surname = re.fullmatch(r"Dr (\w+) (\w+) came\. (\w+) said so; (\w+) (\w+)'s dog\. Smithers and smith stay\.", text).groups()
    assert first == given != "John" and last == again == surname != "Smith" and len(kinds) == 5


def test_country_code_of_one_number():
    text, _ = pii.rewrite("+1 555 123 4567 or 555-123-4567 or +1 (555) 123-4567 or +49 30 1234 5678", {}, KEY)
    numbers = [re.sub(r"\D", "", x) for x in text.split(" or ")]
    assert numbers[0] == "1" + numbers[1] == numbers[2] != "15551234567" and numbers[3][:2] == "49"


@pytest.mark.parametrize("small", [True, False])
def test_one_gender_a_given_name(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(pii, "small", lambda d: False)
    rows = [(1, "Dr Maria Lopez", None), (2, "Mrs Maria Lopez", None), (3, "Mr Kim Lee", None), (4, "Mrs Kim Lee", None), (5, "nothing", None), (6, "Prof Kim Lee, Kim", None)]
    got = {r.doc_id: r.text.split(" ", 1)[1] if " " in r.text else r.text for r in pii.anonymise(docs(spark, rows), KEY).collect()}
    assert got[1] == got[2] and "Maria" not in got[1] and got[1].split()[0].endswith("a")
    assert got[3] == got[4] and got[6].split(", ") == [got[3], got[3].split()[0]]
