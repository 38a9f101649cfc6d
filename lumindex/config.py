"""Search settings: defaults, ranges, and the hash that tells when an index is stale."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

FIELDS = ("title", "content", "excerpt", "taxonomy")  # their position is the stored number

# The English stopwords of the built-in mode.
STOPWORDS = (
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "but", "by", "can", "come", "could", "did", "do", "does",
    "for", "from", "get", "had", "has", "have", "he", "her", "here", "him", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "just", "like", "me", "more", "most", "my",
    "no", "not", "now", "of", "on", "one", "only", "or", "other", "our", "out", "over",
    "said", "same", "see", "she", "so", "some", "such", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "up", "use", "very", "was", "way", "we", "well", "were", "what", "when",
    "where", "which", "while", "who", "will", "with", "would", "you", "your",
)

RANGES = {
    "weight_title": (0.0, 10.0), "weight_content": (0.0, 10.0), "weight_excerpt": (0.0, 10.0), "weight_taxonomy": (0.0, 10.0),
    "bm25_k1": (0.0, 3.0), "bm25_b": (0.0, 1.0), "fuzzy_min_length": (2, 12), "max_expansions": (1, 500), "min_token_length": (1, 10),
    "typeahead_max": (1, 20), "typeahead_debounce": (0, 2000),
}
CHOICES = {"fuzzy": ("off", "one", "auto"), "stopwords_mode": ("none", "builtin", "custom")}


@dataclass(frozen=True)
class SearchConfig:
    """All settings that change results. ``clamped`` brings them into range."""

    post_types: tuple[str, ...] = ("post", "page")
    taxonomies: tuple[str, ...] = ("category", "post_tag")
    fields: tuple[str, ...] = FIELDS
    weight_title: float = 3.0
    weight_content: float = 1.0
    weight_excerpt: float = 1.5
    weight_taxonomy: float = 2.0
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    fuzzy: str = "auto"
    fuzzy_min_length: int = 4
    prefix_last: bool = True
    max_expansions: int = 50
    or_fallback: bool = True
    min_token_length: int = 2
    stopwords_mode: str = "builtin"
    stopwords_custom: str = ""
    stemming: bool = False
    typeahead: bool = True
    typeahead_max: int = 8
    typeahead_debounce: int = 200
    #: Vocabulary size above which typos are not expanded; None: never switched off.
    vocabulary_limit: int | None = None
    max_query_tokens: int = 16
    max_fuzzy_tokens: int = 6
    #: Names of [shortcodes] to strip from content.
    shortcodes: tuple[str, ...] = ()

    def clamped(self, registered_types: tuple[str, ...] | None = None) -> SearchConfig:
        """Numbers into their ranges, unknown choices to the default, empty fields to the title, taxonomy field iff there are taxonomies."""
        new = {k: type(lo)(min(max(getattr(self, k), lo), hi)) for k, (lo, hi) in RANGES.items()}
        new |= {k: getattr(self, k) if getattr(self, k) in known else getattr(SearchConfig, k) for k, known in CHOICES.items()}
        chosen = [f for f in FIELDS if f in self.fields and f != "taxonomy"]
        fields = tuple(chosen + ["taxonomy"] * bool(self.taxonomies)) or ("title",)
        types = tuple(t for t in dict.fromkeys(self.post_types) if registered_types is None or t in registered_types)
        return replace(self, **new, fields=fields, post_types=types, stopwords_custom="\n".join(self.custom_words()))

    def custom_words(self) -> list[str]:
        """Custom stopwords, lower-cased and distinct; accents stay, so accented entries match no folded token."""
        return list(dict.fromkeys(self.stopwords_custom.lower().replace(",", " ").split()))

    def stopwords(self) -> tuple[str, ...]:
        return {"none": (), "builtin": STOPWORDS, "custom": tuple(self.custom_words())}[self.stopwords_mode]

    def weights(self) -> dict[int, float]:
        return {i: getattr(self, f"weight_{name}") for i, name in enumerate(FIELDS)}

    def field_numbers(self) -> list[int]:
        return [FIELDS.index(f) for f in self.fields]

    def pipeline_hash(self) -> str:
        """Changes exactly when an index built with other settings would hold other postings."""
        s = asdict(self)
        relevant = {k: sorted(s[k]) for k in ("post_types", "taxonomies", "fields")} | {k: s[k] for k in ("min_token_length", "stopwords_mode", "stopwords_custom", "stemming")}
        if s["shortcodes"]:  # not a setting of the index by default, but stripped text leaves other postings
            relevant["shortcodes"] = sorted(s["shortcodes"])
        return hashlib.md5(json.dumps(relevant, separators=(",", ":")).encode()).hexdigest()
