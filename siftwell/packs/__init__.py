"""Rule packs: the words, patterns, weights and limits that the operators work with, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Signal:
    name: str
    pattern: str
    title: int = 0
    description: int = 0
    body: int = 0


@dataclass(frozen=True)
class Template:
    """A sentence for a kind of event, with slots in braces.

    `{slot}` is the slot's text, `{slot? tail}` the text and the tail where there is one, `{slot:을}` the text with its
    object particle. The event is met if the title has the pattern and, of each list of words, one stands in the text.
    """

    name: str
    shape: str = "{clause}"
    pattern: str = ""
    #: A pattern for the subject.
    subject: str = ""
    words: tuple[list[str], ...] = ()
    #: Whether the words are looked for in the title alone.
    title_only: bool = False
    #: The shape where the clause lacks this pattern.
    lacking: str = ""
    instead: str = ""
    #: Facts that go before the clause where it lacks them.
    facts: tuple[str, ...] = ("amount",)
    #: supporting: the description's best sentence follows; longer, specific: it replaces a clause that says less.
    detail: str = ""
    #: From where on the clause is cut for the slot `target`; replacements within it, and what stands for an empty one.
    cut: str = ""
    swaps: tuple[tuple[str, str], ...] = ()
    default: str = ""


@dataclass(frozen=True)
class Pack:
    name: str
    #: category -> keywords, in the order that breaks ties.
    categories: dict[str, list[str]]
    default_category: str
    signals: list[Signal]
    #: concept -> pattern; any of several is written with |.
    concepts: dict[str, str]
    tech_category: str = ""
    overseas_category: str = ""
    investment_category: str = ""
    secondary_category: str = ""
    program_category: str = ""
    tech_words: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    advertising: list[str] = field(default_factory=list)
    boilerplate: list[str] = field(default_factory=list)
    bylines: list[str] = field(default_factory=list)
    paywall: list[str] = field(default_factory=list)
    strip: list[tuple[str, str]] = field(default_factory=list)
    particles: list[str] = field(default_factory=list)
    endings: list[str] = field(default_factory=list)
    bare_endings: list[str] = field(default_factory=list)
    sentence_weights: list[tuple[str, int]] = field(default_factory=list)
    category_words: dict[str, list[str]] = field(default_factory=dict)
    event_types: list[tuple[str, str]] = field(default_factory=list)
    event_labels: list[tuple[str, str]] = field(default_factory=list)
    industries: list[tuple[str, str]] = field(default_factory=list)
    amounts: list[str] = field(default_factory=list)
    stages: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    stopwords: list[str] = field(default_factory=list)
    vague: list[str] = field(default_factory=list)
    overseas_sources: list[str] = field(default_factory=list)
    overseas_hosts: list[str] = field(default_factory=list)
    #: Headlines: words of events, words at which a subject ends, subjects that name nobody.
    actions: list[str] = field(default_factory=list)
    subject_ends: list[str] = field(default_factory=list)
    nobody: list[str] = field(default_factory=list)
    #: Stems of events with the verb endings that reports leave out, endings that stand for a plan, joined endings.
    report_stems: list[tuple[str, list[str]]] = field(default_factory=list)
    report_plans: list[tuple[str, str]] = field(default_factory=list)
    joined_endings: list[tuple[str, str]] = field(default_factory=list)
    cut_endings: list[str] = field(default_factory=list)
    openers: list[str] = field(default_factory=list)
    templates: list[Template] = field(default_factory=list)
    title_templates: list[Template] = field(default_factory=list)
    no_summary: str = ""
    key_heading: str = ""

    def concept(self, name: str) -> str:
        """The concept's pattern; one that matches nothing where the pack has none."""
        return self.concepts.get(name, r"(?!)")
