"""Task registry: dataset name -> label words and prompt template.

Names are matched by substring, first match wins, in the reference's order.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal prompts and labels).
# Label words in class order; templates; keyword / synonym / antonym lists;
# the placeholder words of the sst2 "label" pattern.
# ---------------------------------------------------------------------------
LABELS = {
    "sst2": ["negative", "positive"],
    "sst3": ["negative", "natural", "positive"],
    "sst5": ["terrible", "bad", "okay", "good", "great"],
    "CR": ["negative", "positive"],
    "ag": ["world", "sports", "business", "science"],
    "dbpedia": ["company", "school", "artist", "player", "politics", "transport",
                "building", "nature", "village", "animal", "plant", "album", "film", "book"],
}
TEMPLATES = {
    "sst": ("\nReview: ", "\nSentiment: "),
    "CR": ("\nReview: ", "\nSentiment: "),
    "ag": ("\nNews: ", "\nNews type: "),
    "dbpedia": ("\nArticle: ", "\nArticle type: "),
}
SENTIMENT_KEYWORDS = [
    ["poor", "terrible", "worse", "bad", "awful", "fault", "inferior", "problem", "regret", "disappoint"],
    ["excellent", "perfect", "best", "satisfied", "loved", "favorite", "awesome", "superior", "pleasant", "recommend"],
]
SENTIMENT_ANTONYMS = [
    ["good", "bright", "happy", "cheer", "benefit", "fortune", "helpful", "joy", "help", "favorite"],
    ["bad", "dark", "dire", "sorrow", "harm", "down", "dim", "bitter", "sad", "blue"],
]
SENTIMENT_SYNONYMS = [
    ["bad", "dark", "dire", "sorrow", "harm", "down", "dim", "bitter", "sad", "blue"],
    ["good", "bright", "happy", "cheer", "benefit", "fortune", "helpful", "joy", "help", "favorite"],
]
NEWS_KEYWORDS = [
    ["conflict", "election", "global", "crisis", "politics", "war", "peace", "regime", "protest", "climate"],
    ["win", "team", "game", "player", "score", "season", "championship", "coach", "injury", "fans"],
    ["market", "company", "stock", "profit", "loss", "growth", "trade", "startup", "shares", "industry"],
    ["data", "technology", "species", "experiment", "research", "discovery", "theory", "study", "energy", "physics"],
]
ARTICLE_KEYWORDS = [
    ["business", "industry", "market", "employee", "product", "service", "global", "shares", "headquarters", "management"],
    ["education", "students", "teachers", "campus", "classes", "degree", "sports", "research", "library", "principal"],
    ["gallery", "style", "canvas", "commission", "portrait", "modern", "installation", "studio", "critique", "museum"],
    ["sports", "team", "games", "coach", "championship", "training", "record", "league", "medal", "skills"],
    ["government", "policy", "election", "party", "candidate", "debate", "law", "president", "campaign", "vote"],
    ["vehicle", "traffic", "rail", "road", "air", "network", "fuel", "safety", "schedule", "port"],
    ["architecture", "construction", "design", "foundation", "commercial", "material", "engineer", "planning", "urban", "space"],
    ["environment", "forest", "conservation", "species", "habitat", "climate", "ocean", "mountains", "river", "park"],
    ["rural", "community", "population", "tradition", "local", "settlement", "craft", "culture", "families", "homes"],
    ["species", "habitat", "conservation", "bird", "fish", "behavior", "domestic", "wild", "zoo", "migration"],
    ["native", "growth", "flower", "tree", "leaf", "seed", "garden", "conservation", "soil", "root"],
    ["music", "tracks", "artist", "release", "genre", "recording", "label", "chart", "singles", "lyrics"],
    ["movie", "director", "actor", "script", "genre", "cinema", "scene", "audience", "production", "cast"],
    ["author", "novel", "pages", "chapter", "plot", "characters", "edition", "cover", "series", "review"],
]
SST2_PLACEHOLDERS = ["Ne", "por"]
# ---------------------------------------------------------------------------

LABEL_ORDER = ["sst2", "sst3", "sst5", "CR", "ag", "dbpedia"]
TEMPLATE_ORDER = ["sst", "CR", "ag", "dbpedia"]

PATTERNS = ("none", "token", "label", "memo_label_rand", "memo_label_kw",
            "memo_label_syn", "memo_label_ant")


@dataclass(frozen=True)
class Task:
    key: str
    labels: tuple[str, ...]
    prompt_x: str
    prompt_y: str
    coarsen_by: float | None = None   # sst3 reads sst5's rows and floors label/1.5
    # a user's own task: pattern kind ("kw", "syn", "ant") -> one word list per class
    lists: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = ()

    @property
    def n_labels(self) -> int:
        return len(self.labels)


def task_key(name: str) -> str:
    for key in LABEL_ORDER:
        if key in name:
            return key
    raise ValueError(f"unknown task {name!r}: no label set (expected one of {LABEL_ORDER})")


def template(name: str) -> tuple[str, str]:
    for key in TEMPLATE_ORDER:
        if key in name:
            return TEMPLATES[key]
    return ("", "")


def task(name: str) -> Task:
    key = task_key(name)
    x, y = template(name)
    return Task(key, tuple(LABELS[key]), x, y, 1.5 if key == "sst3" else None)


def custom_task(key: str, labels, prompt_x: str = "", prompt_y: str = "", lists: dict | None = None) -> Task:
    """A task of the user's own: label words by class id, template, optional word lists."""
    kept = tuple((kind, tuple(tuple(ws) for ws in per)) for kind, per in sorted((lists or {}).items()))
    for kind, per in kept:
        if len(per) != len(labels) or not all(per):
            raise ValueError(f"{key}: list {kind!r} needs at least one word for each of {len(labels)} classes")
    return Task(key, tuple(labels), prompt_x, prompt_y, lists=kept)


def check_pattern(pattern: str) -> str:
    if pattern not in PATTERNS:
        raise ValueError(f"unknown task pattern {pattern!r}; expected one of {PATTERNS}")
    return pattern


def word_lists(task_: Task, pattern: str, strict: bool = True):
    """Which label words a pattern uses.

    Returns ``("original", None)``, ``("fixed", words)``, ``("tokens", None)``
    (one random vocabulary token per class) or ``("lists", lists)`` (one
    random word per class out of its list).
    """
    check_pattern(pattern)
    if "label" not in pattern:
        return "original", None
    key = task_.key
    if "rand" in pattern:
        return "tokens", None
    kind = "kw" if "kw" in pattern else "syn" if "syn" in pattern else "ant" if "ant" in pattern else None
    own = dict(task_.lists)
    if kind in own:
        return "lists", [list(ws) for ws in own[kind]]
    if key == "sst2":
        if kind is None:
            return "fixed", [[w] for w in SST2_PLACEHOLDERS]
        return "lists", {"kw": SENTIMENT_KEYWORDS, "syn": SENTIMENT_SYNONYMS, "ant": SENTIMENT_ANTONYMS}[kind]
    if key == "CR":
        if kind is None:
            return "tokens", None
        return "lists", {"kw": SENTIMENT_KEYWORDS, "syn": SENTIMENT_SYNONYMS, "ant": SENTIMENT_ANTONYMS}[kind]
    if key == "ag":
        if kind in ("syn", "ant"):
            raise ValueError("task 'ag' defines no synonym/antonym label lists")
        return ("lists", NEWS_KEYWORDS) if kind == "kw" else ("tokens", None)
    if key == "dbpedia":
        if kind in ("syn", "ant") and strict:
            raise ValueError("task 'dbpedia' defines no synonym/antonym lists (strict=False: random tokens)")
        return ("lists", ARTICLE_KEYWORDS) if kind == "kw" else ("tokens", None)
    # sst3 / sst5: every label pattern draws random tokens
    if kind is not None and strict:
        raise ValueError(f"task {key!r} defines no word lists (strict=False: random tokens)")
    return "tokens", None
