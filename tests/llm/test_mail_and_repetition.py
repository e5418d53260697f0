"""Whole texts: markup anywhere in a part of unknown type, and every subject word."""

from platewise.llm import mail, residue


def test_markup_after_a_long_beginning_counts():
    text = "From: a@b\nSubject: x\n\n" + "We met on Monday and talked about the plan. " * 12 + "\n<blockquote>503 Service Unavailable</blockquote>\n<p>See you there.</p>\n"
    assert [k for k, _ in mail.mail_parts(text)] == ["html"]
    assert not any("503" in s or "<p>" in s for s in residue.read_own_part(text).sentences)


def test_all_subject_words_are_read():
    own = residue.read_own_part("Subject: x\n\nHello")
    words = [f"w{'x' * i}" for i in range(60)]
    places = residue.feature_places(own, " ".join(words))
    assert {residue.GRAMS + residue._hashes[w] % residue.TITLES for w in words} <= set(places)


LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris "
    "nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)


def found(body):
    return residue.weak_family(residue.read_own_part("Content-Type: text/plain\n\n" + body)) is not None


def test_repetition_and_filler_count_with_function_words():
    assert found("The quick brown fox jumps over the lazy dog. " * 20)
    assert found(LOREM) and found(LOREM * 9)
    assert not found("The lorem ipsum on page two is still there. Please replace it with the text that I sent you.")
    assert not found("We met on Monday. The plan is fine with us. " * 3)


def test_a_status_in_title_case_is_no_greeting():
    assert all(map(found, ("403 Forbidden", "504 Gateway Timeout", "Loading...")))
    assert not found("Anna Meier\n\nThe plan is fine with us.")


def test_parts_nested_to_any_depth():
    body = "Content-Type: text/plain\n\ninnermost words here\n"
    for i in range(60):
        body = f'Content-Type: multipart/mixed; boundary="=_b{i:03d}"\n\n--=_b{i:03d}\n{body}\n--=_b{i:03d}--\n'
    assert mail.visible_words("Subject: x\n" + body) == [["innermost", "words", "here"]]


def test_long_fields_are_fields():
    assert found("Dear {{" + "a very long name of a field " * 9 + "}},\n\nThe plan is fine with us and we will meet on Monday.")
