"""Word lists of our own, as plain data; every operator takes its lists as parameters.

``CORPUS_*`` hit the invented prose of the test tables; ``NEWS_*`` are for technology news.
"""

from __future__ import annotations

NEWS_TAXONOMY = {
    "ai": ["llm", "neural network", "machine learning", "transformer", "inference"],
    "cloud": ["kubernetes", "serverless", "container", "data center"],
    "hardware": ["gpu", "chip", "semiconductor", "risc-v"],
    "open source": ["linux", "compiler", "git", "apache"],
    "security": ["zero-day", "ransomware", "exploit", "vulnerability", "phishing"],
    "startups": ["funding", "series a", "acquisition", "ipo"],
}
NEWS_EXCLUSIONS = ["horoscope", "recipe", "celebrity", "lottery"]

CORPUS_TAXONOMY = {
    "alpha": ["tion", "ther", "thon"],
    "beta": ["thth", "than", "thre"],
    "delta": ["erin", "thble", "eron"],
    "gamma": ["thes", "thed", "anea of"],
    "kappa": ["attion", "thanea", "antion"],
    "omega": ["eriner", "onin", "oned the"],
}
CORPUS_EXCLUSIONS = ["ersh", "thwh"]
CORPUS_POSITIVE = ["thon", "than", "thes", "tion", "attion"]
CORPUS_NEGATIVE = ["thre", "erin", "eron", "loser", "idiot", "trash"]
CORPUS_WEIGHTS = {"tion": 0.5, "ther": 0.8, "thon": 0.9, "than": 0.7, "attion": 1.0, "eron": 0.6}
CORPUS_GAZETTEER = {"companies": ["ther", "thon", "erin"], "products": ["thble", "attion"], "people": ["anea", "onin"]}
CORPUS_STOP = ["the", "and", "that", "with", "from", "this", "dans", "pour", "avec", "eine", "nicht"]

#: Query parameters that only track.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref fbclid gclid igshid mc_eid _ga _hsenc _openstat ysclid msclkid spm scm trcid twclid".split()
#: Prefixes of a headline that say nothing.
TITLE_PREFIXES = ["breaking", "update", "updated", "exclusive", "watch", "video", "opinion"]
#: Headlines that bait, and words of text behind a paywall (patterns, both case-blind).
CLICKBAIT = [r"\b(must see|can'?t miss)\b", r"\bdoctors hate\b", r"\bjaw[- ]dropping\b", r"\b(went|goes|going) viral\b", r"\bthe reason will\b", r"\bnumber \d+ is\b", r"[!?]{2,}"]
PAYWALL = [r"\bunlock this (article|story)\b", r"\bthis (article|story) is for members\b", r"\bsign up for full access\b", r"\bstart your free trial\b", r"\bno free articles left\b"]
#: Headline patterns by their effect on importance; the first that matches counts.
HIGH_IMPACT = [
    (r"\b(exploited in the wild|unpatched|backdoor|wormable|leaked credentials|emergency patch)\b", 0.25),
    (r"\b(open weights|record benchmark|first of its kind|milestone|new generation of chips)\b", 0.20),
    (r"\b(takeover|bankruptcy|regulators?|fined|layoffs|goes public)\b", 0.20),
    (r"\b(outage|recall|kernel release|supply chain|standard approved|end of life)\b", 0.15),
]
LOW_IMPACT = r"\b(walkthrough|for beginners|weekly roundup|changelog|rumou?rs?|column|in review)\b"
#: Links that lead to no page: schemes, sections of a site, endings of files.
NO_PAGES = "data javascript mailto sms tel".split()
ASIDE = "about account basket careers checkout events feedback help imprint jobs legal login newsletter register rss search settings shop sitemap subscribe support tags terms".split()
FILES = "avi css csv docx exe gif ics jpeg jpg js mov mp3 mp4 pdf png pptx svg tar webm webp xlsx xml zip".split()
#: Sections that hold articles.
SECTIONS = "analysis article dispatch features interview live news reports reviews stories".split()
