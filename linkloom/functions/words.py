"""Word lists. Fixed values, in natural order."""

STOP_WORDS = (
    "the a an and or but of to in for on with is are was were be been being this that these those it its as at by from into "
    "out up down over under above below than then there here when where why how what which who whom all any some each every both few more "
    "most other such no nor not only own same so too very can will just should now i me my we us our ours you your yours he him "
    "his she her hers they them their theirs do does did doing have has had having would could shall may might must if because while "
    "about after before again further once get got make makes made need needs want wants use uses used using also well back even still way"
).split()

GENERIC_ANCHORS = [
    "click here", "click", "here", "this", "this page", "this post", "this article", "read more", "more", "learn more", "find out more", "see more", "view more",
    "read this", "read it", "link", "this link", "go", "go here", "check it out", "check this out", "see here", "view", "details", "more info", "more information",
    "full article", "full post", "continue reading", "read on", "website", "page", "article", "post", "download", "visit", "visit us", "our site", "homepage",
]


def weak_words(extra: tuple[str, ...] = ()) -> set[str]:
    """Words that may not start, end or be an anchor: the stop words and a site's own list of padding words."""
    return {*STOP_WORDS, *(w.strip().lower() for w in extra if w.strip())}


def ignore_words(extra: str = "") -> set[str]:
    """Stop words and a comma-separated list of the user's."""
    return {*STOP_WORDS, *(w.strip() for w in extra.lower().split(",") if w.strip())}
