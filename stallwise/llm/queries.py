"""Imports every operator module, which registers its query."""
from . import (covertree, cross_polytope, fingerprints, lines, minhash, mixing, quotes, repair, sentence_pieces,  # noqa: F401
               substrings, token_files, toxicity, whitening)
from .common import ORACLES, QUERIES  # noqa: F401
