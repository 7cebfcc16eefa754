"""Rule packs, dictionaries and price lists: configuration as plain data."""

from textlots.packs.contracts import CONTRACTS
from textlots.packs.incidents import INCIDENTS
from textlots.packs.model import Pack, Rule
from textlots.packs.reviews import REVIEWS

PACKS = {pack.domain: pack for pack in (REVIEWS, CONTRACTS, INCIDENTS)}


def get_pack(domain: str) -> Pack:
    """The pack of a domain; an unknown domain gets the reviews pack."""
    return PACKS.get(domain, REVIEWS)


__all__ = ["CONTRACTS", "INCIDENTS", "PACKS", "REVIEWS", "Pack", "Rule", "get_pack"]
