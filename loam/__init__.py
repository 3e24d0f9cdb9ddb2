"""Tidy verbs that build Spark DataFrames. ``import loam`` costs nothing until a name is used."""

import importlib


def __getattr__(name: str):
    if name.startswith("__"):
        raise AttributeError(name)
    api = importlib.import_module(".api", __name__)
    return api if name == "api" else getattr(api, name)
