"""Typeset words: every kind of markup that texts carry."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latentspark.llm import latex


def main(text):
    return latex.reading_streams(text)[0]


@pytest.mark.parametrize(
    "text, words",
    [
        (r"gegen\"uber gro{\ss}e \'{\i}ndices Seg\'un ni\~no \c{c}a", "gegenuber grosse indices segun nino ca"),
        (r"a \emph{few, \textbf{nested}} words{\em here}", "a few nested wordshere"),
        ("ta\\-ble warm-up lock-\nfree it's", "table warmup lockfree its"),
        (r"left $48$ of $x^2$ and \(y_1\) here", "left 48 of and here"),
        ("one \\[ a = b \\] two $$c$$ three \\begin{equation*}\nd\n\\end{equation*} four", "one two three four"),
        (r"one~\cite{key} two \citep[see][p. 3]{k2} three\footnote{a note} four \input{parts/x} five", "one two three four five"),
        ("one % comment\ntwo\n% more\nthree 50\\% four", "one two three 50 four"),
        (r"\newcommand{\abc}{Big Name}\def\zz{small}x \abc{} y \zz{} \abc\ z", "x big name y small big name z"),
        (r"\newcommand{\hl}[1]{\textbf{#1} indeed}say \hl{some words} now", "say some words indeed now"),
        ("plain words, no markup!", "plain words no markup"),
        ("a\r\nb\rc", "a b c"),
    ],
)
def test_words(text, words):
    assert main(text) == words.split()


def test_notes_comments_and_bodies_have_streams_of_their_own():
    text = "run one\\footnote{in the note} run two % hidden\n% comment\n\\newcommand{\\x}{five words in a body}"
    assert latex.reading_streams(text) == [["run", "one", "run", "two"], ["in", "the", "note"], ["hidden", "comment"], ["five", "words", "in", "a", "body"]]


def test_the_last_definition_before_a_use_holds():
    assert main(r"\def\a{one} \a{} \def\a{two} \a{}") == ["one", "two"]


def test_recursive_macros_end():
    assert len(main(r"\def\a{\a\a x} \a")) < 10_000


@pytest.mark.parametrize(
    "text, words",
    [
        ("".join(rf"\newcommand{{\m{'abcdefghij'[k]}}}{{\m{'abcdefghij'[k + 1]}{{}}}}" for k in range(9)) + r"\newcommand{\mj}{deep words} say \ma{} now", "say deep words now"),
        (r"\newcommand{\two}[2]{first #1 then #2 last}\two{alpha}{beta}", "first alpha then beta last"),
        (r"\newcommand{\three}[3][none]{#1 #2 #3} \three{a}{b} \three[c]{d}{e}", "none a b c d e"),
        (r"\def\pair#1#2{#2 and #1}\pair{one}{two \pair{x}{y}}", "two y and x and one"),
        (r"\newcommand{\deep}{a {b {c {d {e}}}}} \deep{}", "a b c d e"),
        (r"\newcommand{\one}[1]{#1}\one x \one{\one{inner}}", "x inner"),
        (r"\newcommand{\a}{left}\let\b\a \b{}", "left"),
        ("one\\\\[2pt] two \\{three\\}", "one two three"),
        ("a $" + "x " * 3000 + "$ b", "a" + " x" * 3000 + " b"),
        ("costs 5$ here\n\nand $y^2$ there", "costs 5 here and there"),
        (r"note\footnote{a {b {c {d}}} e} end", "note end"),
    ],
)
def test_macros_of_any_depth_and_many_arguments(text, words):
    assert main(text) == words.split()


def test_bodies_over_lines_comments_with_macros_and_cycles():
    lines = "\n".join("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split())
    assert latex.reading_streams("\\newcommand{\\x}{" + lines + "}")[-1] == lines.split()
    assert latex.reading_streams("\\newcommand{\\n}{Big Name}\ntext\n% see \\n{} here")[1] == ["see", "big", "name", "here"]
    assert main(r"\def\a{x \b}\def\b{y \a} \a{} end") == ["x", "end"]


def test_prose():
    text = "\\documentclass{a}\n\\title{T}\n\\begin{document}\nOne two. Three\\cite{x} four!\n\n% no\nFive $a^2$ six.\n\\begin{thebibliography}{9}\nno\\end{thebibliography}\n\\end{document}"
    assert latex.prose_sentences(text) == [["one", "two"], ["three", "four"], ["five", "six"]]
    assert latex.prose_sentences("\\documentclass{a}\n\\title{only a head}") == []
    assert latex.prose_sentences("just text") == [["just", "text"]]
    assert latex.prose_sentences("") == []


def test_long_texts_take_linear_time():
    for piece in ("{", "$", "\\[", "%", "\\newcommand{\\x}{", "\\footnote{", "a-\n", "\\begin{equation}", '\\"a', "word "):
        latex.reading_streams(piece * 20_000)
        latex.prose_sentences(piece * 20_000)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \\{}$%[]#\n~'\"-", max_size=60))
def test_any_text_is_read(text):
    assert all(w for s in latex.reading_streams(text) for w in s)
    latex.prose_sentences(text)
