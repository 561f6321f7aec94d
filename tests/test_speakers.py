"""The speaker fold, line by line."""

from talespark.operators import speakers
from talespark.operators.speakers import Cast, Fold

CAST = [("Marek Vane", "M"), ("ilse", "F"), ("Tobias", "M")]


def line(text, kind="dialogue", raw=None, attribution=None):
    return {"text": text, "type": kind, "raw": raw or text, "attribution": attribution}


def fold(mentions=(), **options):
    return Fold(Cast(CAST), mentions=list(mentions), **options)


def test_pronoun_means_the_only_woman():
    assert fold().step(line("She turned away from the window.", "narration"), None)[0] == "Ilse"


def test_narration_without_cues_keeps_the_subject():
    f = fold()
    f.step(line("Tobias's coat was wet.", "narration"), None)
    assert f.step(line("The rain went on.", "narration"), None)[0] == "Tobias"


def test_lower_case_name_is_shown_in_its_own_case():
    assert fold().step(line("then ilse stopped.", "narration"), None)[0] == "Ilse"


def test_names_do_not_match_inside_words():
    assert Cast([("Eve", "F")]).named("never ever evening") is None


def test_attribution_overrides_the_subject():
    f = fold()
    f.step(line("Ilse's lamp went out.", "narration"), None)
    assert f.step(line("Stay here.", attribution="Tobias said."), line("He left.", "narration"))[0] == "Tobias"


def test_next_narration_names_the_speaker():
    assert fold().step(line("Wait.", raw='"Wait."'), line("Tobias whispered.", "narration"))[0] == "Tobias"


def test_pronoun_attribution_takes_the_last_fitting_mention():
    f = fold(["Ilse", "Tobias"])
    assert f.step(line("Who is there?", attribution="he asked."), None)[0] == "Tobias"


def test_possessive_pronoun_means_the_last_man():
    assert fold(["Tobias", "Marek Vane", "Ilse"]).step(line("His hand shook.", "narration"), None)[0] == "Marek Vane"


def test_unknown_speech_is_ambiguous_with_candidates():
    assert fold().step(line("Hello."), None) == ("Ambiguous", ["ilse", "marek vane", "tobias"])


def test_outsider_keeps_speech_open():
    f = Fold(Cast([("Marek", "M")]))
    assert f.step(line("She sighed.", "narration"), None)[0] == "Narrator"
    assert f.subject and f.step(line("Go."), None)[0] == "Ambiguous"


def test_strict_and_aggressive_match_members_only():
    for mode in ("strict", "aggressive"):
        f = fold(mode=mode, auto_assign=False)
        assert f.step(line("Tell Tobias nothing."), None)[0] == "Tobias"
        assert fold(mode=mode, auto_assign=False).step(line("Nobody."), None)[0] == "Ambiguous"
    assert fold(mode="aggressive", initials=False).step(line("Ask Vane."), None)[0] == "Marek Vane"
    assert fold(mode="strict").step(line("Tobias and ilse."), None)[0] == "Narrator"


def test_names_within_words_need_no_pattern(monkeypatch):
    """A verb's patterns are tried only where a word of the text begins as a name does; signs are as before."""

    class Never:
        def search(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(speakers, "_NAMED", (Never(),))
    monkeypatch.setattr(speakers, "_VERB", Never())
    seen = Fold(Cast([("Ann", "F"), ("Bob", "M")])).look(line("The channel was planned, said nobody.", "narration"), None)
    assert (seen.own.named, seen.own.inside, seen.own.verb, seen.about) == (None, "ann", None, None)


def test_names_by_verbs_in_odd_writing():
    """Marks within a name's token, letters with long lower cases and final sigmas."""
    verb = lambda text, name: Fold(Cast([(name, "F")])).look(line(text), None).own.verb
    assert verb("Channel: A*nn said", "Ann") == "ann"
    assert verb("channel A*nn left", "Ann") is None
    assert verb("said *İan* then", "İan") == "i̇an"
    assert verb("_ΒΟΣ_ ΒΟΣ; said", "ΒΟΣ") == "βος"
