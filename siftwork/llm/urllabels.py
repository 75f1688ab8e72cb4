"""A small labelled URL table, to be replaced by a team's own.

Hosts are two common words of one sort under names that can't exist. The words
were chosen by topic: what block lists are about, and what ordinary sites are
about. Four hosts in five are harmless, as on the web, so letters that the model
has not seen speak for a harmless host. Every host has every prefix and every
path alike, so only its name tells.
"""

from __future__ import annotations

BLOCK = (
    "slots poker jackpot roulette pharmacy viagra meds loans cash replica xxx porn escort webcam singles warez cracks torrents popunder clicks lottery prize "
    "doubler keylogger bonus payday forex miracle slimming hookup nulled keygen botnet counterfeit giveaway phishing malware stalkerware proxies downloader"
).split()
ALLOW = (
    "library museum university docs kernel school history science garden recipes radio news gazette river maps birds astronomy language poetry travel chess music philosophy books encyclopedia city council hospital clinic railway "
    "archive journal research festival orchestra football cycling hiking cooking baking coffee forest ocean climate energy engineering robotics software database compiler network standards law court parliament embassy charity church pottery "
    "painting cinema opera ballet drama novel comics biology chemistry physics geology botany zoology medicine nursing dental optics economy market bank insurance housing building carpentry plumbing gardening knitting sewing fashion "
    "shoes toys games puzzles cards sports tennis rowing sailing skiing climbing swimming running yoga dogs cats horses bees flowers fruit grain dairy cheese bread wine beer tea family kids parents pupils college campus lecture course exam"
).split()
PATHS = ["", "index.html", "2021/05/a-post", "shop/item?id=3"]
PREFIXES = ["", "www.", "blog.", "m."]


def hosts(words: list[str]) -> list[str]:
    """Two hosts for each word, with two others of the list behind it."""
    words = list(dict.fromkeys(words))
    return [f"{w}-{words[(i + k) % len(words)]}" for i, w in enumerate(words) for k in (1, 2)]


def labelled(block: list[str] = BLOCK, allow: list[str] = ALLOW) -> list[tuple[str, int]]:
    """(url, label) of every host; 1 is to be blocked."""
    return [(f"https://{pre}{h}.{d}/{p}", y) for y, words in ((1, block), (0, allow)) for h in hosts(words) for pre, d, p in zip(PREFIXES, ["test", "invalid"] * 2, PATHS, strict=True)]
