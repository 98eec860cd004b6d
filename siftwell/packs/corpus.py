"""A pack for the synthetic document tables, whose words are invented: its rules name tokens that occur there."""

from __future__ import annotations

from siftwell.packs import Pack, Signal

PACK = Pack(
    name="corpus",
    categories={
        "licence": ["license", "licensed", "copyright", "rights reserved", "version"],
        "english": ["the", "and", "with", "from", "this"],
        "french": ["les", "une", "dans", "pour", "est"],
        "german": ["und", "der", "nicht", "mit", "sich"],
        "spanish": ["los", "una", "para", "con", "del"],
    },
    default_category="english",
    tech_category="licence",
    overseas_category="spanish",
    investment_category="french",
    secondary_category="german",
    program_category="licence",
    signals=[
        Signal("licensed", r"licensed|license", 13, 7, 3),
        Signal("rights", r"rights\s*reserved|copyright", 12, 6, 3),
        Signal("numbers", r"[0-9]{4,}", 8, 4, 2),
        Signal("address", r"[a-z0-9._]+@[a-z0-9.]+", 9, 5, 2),
        Signal("table", r"[|]", 5, 3, 1),
        Signal("romance", r"les|una|para|est"),
        Signal("germanic", r"und|der|the|with"),
    ],
    concepts={
        "funding_verb": r"\b([A-Z][a-z]{1,39})\s+(the|les|der|los)\b",
        "funding_amount": r"\b(?:is|est|ist|es|and|und)\b",
        "market_noise": r"[$%&#]{3}",
        "ecosystem_link": r"licen[cs]e|version",
        "target": r"\bthe\b|\bles\b|\bder\b|\blos\b",
        "ecosystem": r"version|public",
        "actor": r"\bwith\b|\bmit\b|\bcon\b|\bpour\b",
        "financing": r"reserved|licensed",
        "support": r"\bfor\b|\bdans\b|\bpara\b",
        "collaboration": r"\band\b|\bund\b|\bet\b",
        "large_company": r"[A-Z]{6,}",
        "listed": r"[A-Z]{6,}",
        "achievement": r"[0-9]{6,}",
        "capex": r"[*]{3}",
        "event": r"\bis\b|\best\b|\bist\b|\bes\b",
        "market_event": r"public.{0,20}version",
        "tech_business": r"licensed.{0,45}version",
        "origin": r"\bwas\b.{0,30}\bhe\b",
        "investment": r"licensed|rights",
        "direct_investment": r"licensed|released",
        "support_category": r"\bfor\b.{0,30}\bthe\b",
        "partnership": r"work.{0,20}licensed",
        "institutional_support": r"general.{0,20}public",
        "strong_event": r"licensed|released|reserved",
        "editorial": r"!!.{0,20}!!",
        "outlook": r"\bby\b.{0,20}\bthis\b",
        "large_general": r"[A-Z]{6,}.{0,35}[A-Z]{6,}",
        "overseas": r"\blos\b|\blas\b",
        "advice": r"\bque\b.{0,10}\bde\b",
        "general_tech": r"[#]{3}",
        "rights_issue": r"rights",
        "market_words": r"[$]{3}",
        "plant": r"[|]",
        "award": r"[&]{3}",
        "secondary": r"noncommercial|BY-NC",
        "program": r"GNU|Apache",
        "summary_metadata": r"copyright|[a-z0-9._]+@[a-z0-9.]+",
        "sentence_metadata": r"copyright|rights\s*reserved|[a-z0-9._]+@[a-z0-9.]+",
        "fallback_event": r"\bis\b|\bwas\b|\best\b|\bist\b",
        "fallback_strong_event": r"\bis\b|\bist\b",
        "report_ending": r"[a-z]$",
        "title_event": r"\bis\b|\best\b",
        "english_event": r"\bis\b|\bwas\b|\bare\b",
        "weak": r"\bonly\b",
        "advert": r"[$%&#*]{3}",
        "action": r"\bto\b|\bzu\b|\bde\b",
        "context": r"licen[cs]e",
        "complete_ending": r"[a-zé][.!?]$",
        "structured_subject": r"\bthe\b|\bles\b",
        "structured_action": r"[a-z]$",
        "institution": r"\bpublic\b",
        "stock_sentence": r"[0-9]{6,}",
        "promotion": r"!!",
        "money": r"[$€]\s*[0-9]",
        "subject": r"\bthe\s",
    },
    tech_words=["license", "version", "work"],
    sources=["src1", "src2", "src3", "src7"],
    advertising=["free", "sale"],
    boilerplate=[r"rights\s*reserved", r"licen[cs]e"],
    bylines=[r"^by [a-z ]{2,20}$"],
    paywall=[r"subscribers only"],
    strip=[(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", " ")],
    sentence_weights=[("the", 6), ("and", 4), ("is", 5), ("les", 6), ("und", 6), ("los", 6), ("license", 10)],
    category_words={"english": ["of", "that"], "licence": ["license"]},
    event_types=[("licence", r"licen[cs]e"), ("rights", r"rights"), ("number", r"[0-9]{3,}")],
    event_labels=[("Licence", r"licen[cs]ed?"), ("Rights", r"rights"), ("Table", r"[|]")],
    industries=[("GNU", r"gnu"), ("Apache", r"apache"), ("Creative", r"cc by")],
    amounts=[r"([0-9]+(?:[.][0-9]+)?)"],
    stages=[r"(version\s*[0-9]+)"],
    companies=[r"\b(GNU|Apache|MIT)\b"],
    stopwords=["the", "and", "of"],
    overseas_sources=["src1", "src3"],
    overseas_hosts=["example.net"],
)
