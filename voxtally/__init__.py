"""Conversation and feedback analytics on Spark DataFrames."""

from voxtally.plans.analyze import analyze
from voxtally.rules import Cascade, Dictionary, Profile, default_profile

__all__ = ["analyze", "Cascade", "Dictionary", "Profile", "default_profile"]
