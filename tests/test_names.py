import pytest
from pyspark.sql import functions as F

from corpusflow.functions import names as N


@pytest.mark.parametrize(
    "raw, name",
    [
        ("Smith, R. Bosworth (Reginald Bosworth), 1839-1908", "R. Bosworth Smith"),
        ("KATE EZRA", "Kate Ezra"), ("Dr Issoufou", "Issoufou"), ("unesco", "UNESCO"), ("A, B, C", "A, B, C"),
        ("Assistant Editor I. Hrbek", "I. Hrbek"), ("Ajayi, J., ed.", "J Ajayi"), (None, ""), ("O'NEIL MARY", "O'Neil Mary"),
    ],
)
def test_clean_name(one, raw, name):
    assert one(N.clean_name, raw) == name


@pytest.mark.parametrize(
    "name, person, creator",
    [
        ("Kyle", False, False), ("Microsoft Word", False, True), ("Colin Hope", True, True), ("UNESCO", False, True),
        ("elgamelyan", False, False), ("Genesis2023", False, False), ("Institute of Education", True, True), ("", False, False),
        ("Nguyễn Văn", True, True),
    ],
)
def test_plausible(one, name, person, creator):
    assert one(N.is_plausible_person, name) is person
    assert one(N.is_plausible_creator, name) is creator


def test_lists(one):
    assert one(N.split_name_list, "M. El Fasi, I. Hrbek; Ajayi, J") == ["M. El Fasi", "I. Hrbek", "Ajayi, J"]
    assert one(N.split_name_list, "Ann Lee and Bo Ng & Cy Do") == ["Ann Lee", "Bo Ng", "Cy Do"]
    assert one(lambda s: N.unique_names(F.split(s, ";")), "Török;Torok;;Ann") == ["Török", "Ann"]
    assert one(lambda s: N.format_authors(F.split(s, "")), "ABCDEFG") == "A; B; C; D; E; F; et al."
    assert one(lambda s: N.format_authors(F.split(s, "")), "AB") == "A; B"
    assert one(N.first_author, " A B ; C") == "A B"
    assert one(N.first_author, "Unknown") == ""


def test_evidence(one):
    assert one(N.name_in_text, "Colin A. Hope", "we hope that") is False
    assert one(N.name_in_text, "Colin Hope", "by c. a. hope") is True
    assert one(N.name_in_text, "Colin Hope", "hope, colin") is True
    assert one(N.name_in_text, "Hope", "hope") is False
    assert one(N.surname_in_text, "Colin Török", "by torok.") is True
    assert one(N.surname_in_text, "Colin Hope", "hopeful") is False


def test_tidy(one):
    assert one(N.tidy_extracted_name, "Djardaye MALAM ISSOUFOU") == "Djardaye Malam Issoufou"
    assert one(N.tidy_extracted_name, "Olu ́se O ́KE").replace("́", "") != ""
