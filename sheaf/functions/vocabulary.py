"""The words that clinical text functions go by, grouped by what they mean. All are compared without case; a blank stands for any white space."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Vocabulary:
    """Entries are plain words, or regular expressions where a form varies."""

    #: Kinds of notes that somebody writes or signs, and the short forms of their titles.
    note_kinds: tuple[str, ...] = (
        "admission note",
        "after visit summary",
        "care plan",
        "clinical note",
        "consult(?:ation)? note",
        "discharge note",
        "ed provider note",
        "history and physical",
        "h&p",
        "lactation note",
        "nursing note",
        "operative note",
        "plan of care",
        "procedure note",
        "progress note",
        "provider note",
        "telephone encounter",
        "therapy note",
        "triage note",
        "visit summary",
    )
    #: Headings of a note's parts: the story, the findings, the judgement, what is to be done.
    story: tuple[str, ...] = ("Chief Complaint", "History of Present Illness", "Reason for Consult", "Reason for Visit", "Past Medical History", "Past Surgical History", "Family History", "Social History", "Birth History", "Maternal History", "Review of Systems", "Subjective", "Interval History")
    findings: tuple[str, ...] = ("Physical Exam", "Vital Signs", "Vitals", "Objective", "Recent Results", "Fetal Monitoring", "Respiratory Support", "Nutrition", "Growth")
    judgement: tuple[str, ...] = ("Assessment and Plan", "Assessment", "Impression", "Problem List", "Hospital Course", "Discharge Summary", "Discharge Diagnosis", "Indication", "Complications")
    orders: tuple[str, ...] = ("Plan", "Instructions", "Home Medications", "Active Medications", "Medications", "Allergies", "Procedure", "Procedure Time", "Performing Provider", "Follow Up")
    #: What tells that a text is a note and no page frame: any of these, anywhere. Fixed values.
    note_text: tuple[str, ...] = (
        "progress notes? by",
        "progress notes? signed by",
        "progress note date of service",
        "ed provider notes? by",
        "procedure notes? by",
        "telephone encounter by",
        "plan of care by",
        "lactation note by",
        "h&p signed by",
        "admit summary",
        "neuraxial procedure note",
        "chief complaint",
        "history of present illness",
        "reason for consult",
        r"maternal hx\s*:",
        r"lactation note\s*:",
        r"assessment\s*:",
        r"assessment and plan\s*:",
        r"subjective\s*:",
        r"objective\s*:",
        r"procedure\s*:",
        r"procedure note\s*:",
        r"procedure time\s*:",
        r"indications?\s*:",
        r"complications?\s*:",
        r"date/time note written\s*:",
        r"preprocedure check\s*:",
        r"performing provider\s*:",
        r"authorizing provider\s*:",
        "urine dip",
        "flank pain",
        "vitals?",
        r"vs\s*:",
        "reviewed that",
        "patient (?:called|states?|here|presents)",
        "nurse spoke with patient",
        "hospital course",
        "discharge",
        "vital signs",
        "physical exam dol",
        "room air",
        "nicu",
        "infant",
        "active medications?",
        "respiratory support",
        "fen assessment",
        r"medications\s*:",
        r"plan\s*:",
        r"instructions?\s*:",
    )
    #: Entries of a page's menu, and starts of lines that are only buttons.
    menu: tuple[str, ...] = ("menu", "main menu", "your menu", "home", "search", "search the menu", "clear search field", "close the menu", "change language", "high contrast", "log out", "switch patients", "messaging", "account settings", "skip navigation")
    buttons: tuple[str, ...] = ("view", "show", "hide", "expand", "collapse", "compare", "learn more")
    #: Whole lines that are a page's own; a portal's names of itself go here too. Fixed values.
    page_lines: tuple[str, ...] = (
        "menu", "main menu", "search", "search the menu", "clear search field", "messaging", "home", "results", "test results", "test results list", "visits", "appointments and visits", "medications", "letters", "health summary",
        "terms and conditions", "non-discrimination", "privacy policy", "copyright", "download", "print", "back to top", "share everywhere", "open scheduling", "log out", "logout", "close", "close the menu", "more", "next", "previous",
        "additional information", "prescription details", "refill details", "request a refill", "remove", r"how can i help you\??", "schedule an appointment", "cancel an appointment", "reschedule an appointment", "pay my bill", "more options", "ask me a question",
        "switch patients", "change language", "billing", "billing summary", "insurance", "insurance summary", "sharing",
    )
    #: Whole lines with which the footer of a visit's page starts; a portal's help desk goes here too. Fixed values.
    footer: tuple[str, ...] = ("interoperability guide", "terms and conditions")
    #: Phrases of a page's own that stand inside clinical lines, by category ('' for all).
    widgets: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("compare result trends", "view trends", r"loading\.\.\.", "opens externally"),
            "test-results": (r"waiting to start\.\.\.", "test results list"),
            "medications": ("learn more", "request a refill", "refill details", "prescription details", "additional information"),
            "visits": ("close the menu", "high contrast", "download this file", "not yet viewed", "print this page", "skip navigation to main content", "view clinical notes?", "appointments and visits list"),
        }
    )
    #: Labels before the name of a result in a list, and states behind it.
    row_labels: tuple[str, ...] = ("lab", "procedure", "imaging")
    row_states: tuple[str, ...] = ("abnormal", "normal", "final result")
    #: Titles that say nothing.
    generic_titles: tuple[str, ...] = ("abnormal", "appointments and visits list", "billing", "date value normal range", "final result", "health summary", "lab", "letters", "medications", "notes from care team", "procedure", "results", "test results", "test results list", "value", "visits")
    #: Words of a visit's title that no author names.
    visit_words: tuple[str, ...] = ("visit", "hospital", "clinical support", "anesthesia event")
    #: Words of imaging titles.
    modalities: tuple[str, ...] = ("xr", "x-?ray", "cxr", "ct", "mri", "us", "ultrasound", "radiology", "imaging", "chest", "abdomen")
    #: Specimens, in the order in which they are looked for, and flags of lab values. Fixed values.
    specimens: tuple[str, ...] = ("capillary", "arterial", "venous", "serum", "plasma", "urine", "blood")
    flags: tuple[str, ...] = ("high", "low", "abnormal", "critical")
    #: Results that are words, and what stands before a value.
    word_results: tuple[str, ...] = ("positive", "negative", "detected", "not detected", "none seen")
    value_labels: tuple[str, ...] = ("normal range", "normal value", "your value is", "value")
    #: Phrases of pages of visits that hold no note: of their lists, of their details, and titles of their frames. A portal's own page titles go here too. Fixed values.
    list_frames: tuple[str, ...] = ("load more past visits", "oldest record loaded", "visit is from another organization", "there are no upcoming visits to display", "there are no past visits to display", "this was a hospital visit")
    detail_frames: tuple[str, ...] = ("notes from care team", "after visit summary", "please enable javascript", "interoperability guide", "terms and conditions", "there are no upcoming visits to display", "there are no past visits to display", "this was a hospital visit")
    frame_titles: tuple[str, ...] = ("notes from care team",)
    #: Short titles of real notes. Fixed values.
    note_titles: tuple[str, ...] = ("procedure notes?", "progress notes?", "ed provider notes?", "anesthesia procedure notes?", "anesthesia progress notes?", "anesthesia ed provider notes?")
    #: Marks of a page's program; a portal's own go here.
    program: tuple[str, ...] = ("<script\\b", "<meta http-equiv", "document\\.getElementById", "function\\(\\)\\{")
    #: Characters of a note at least, and of a page without a note at most. Fixed values.
    least_note: int = 500
    largest_shell: int = 50_000

    @property
    def headings(self) -> tuple[str, ...]:
        return (*self.story, *self.findings, *self.judgement, *self.orders)


DEFAULT = Vocabulary()


def phrase(words: str) -> str:
    return words.replace(" ", r"\s+")


def any_of(words: Iterable[str]) -> str:
    """An alternation, longer entries first so that none hides behind its own beginning; of no words, what nothing matches."""
    some = sorted(set(words), key=lambda w: (-len(w), w))
    return "(?:" + "|".join(map(phrase, some)) + ")" if some else "(?!)"


def authored(v: Vocabulary) -> str:
    """A kind of note, with who wrote or signed it."""
    return rf"\b{any_of(v.note_kinds)}s?\s+(?:signed\s+)?by\b"


def substance(v: Vocabulary) -> str:
    """What a text with a note's substance holds."""
    return rf"(?i){any_of(v.note_text)}"


def note_marker(v: Vocabulary) -> str:
    """What a note says and a mere visit does not: a kind of note, or a heading of two words and more."""
    return rf"(?i)\b(?:{any_of([*v.note_kinds, *(h for h in v.headings if ' ' in h)])}s?)\b"

