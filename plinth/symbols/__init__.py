"""The symbol library: detectors by scope.  Opening symbols compete, room and plan symbols add up."""

from plinth.symbols import openings, plans, rooms  # noqa: F401  (registers the detectors)
from plinth.symbols.base import Match, OpeningContext, PlanContext, RoomContext, Symbol, best_match, registry, symbols_for

__all__ = ["Match", "OpeningContext", "PlanContext", "RoomContext", "Symbol", "best_match", "registry", "symbols_for"]
