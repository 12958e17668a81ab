"""Spark-native document retrieval and corpus preparation."""

from passagemill.config import ConfigError, EngineConfig

__all__ = ["ConfigError", "EngineConfig"]
