"""Typed operations of the engines; ``operation names`` are those of the request schemas."""

from __future__ import annotations

from quillon.engines.base import Engine


def engines() -> dict[str, type[Engine]]:
    """The engine of each prefix of operation names."""
    from quillon.engines import cache, friends, hints, lists, news, photo, search, small, statsx, targ, text

    return {
        "cache": cache.Cache, "friends": friends.Friends, "hints": hints.Hints, "rating": hints.Rating, "isearch": small.Isearch, "lists": lists.Lists, "memcache": small.Memcache, "news": news.News, "cnews": news.Cnews, "nnews": news.Nnews, "rnews": news.Rnews,
        "photo": photo.Photo, "random": small.Random, "rpcProxy": small.RpcProxy, "search": search.Search, "seqmap": small.Seqmap, "statsx": statsx.Statsx, "storage": small.Storage, "targ": targ.Targ, "text": text.Text, "weights": small.Weights,
    }


def all_operations() -> dict[str, str]:
    """Operation name -> its arguments, as ``name:type ...``."""
    return {n: " ".join(f"{a}:{t}" for a, t in o.arguments.items()) for e in engines().values() for n, o in e.operations.items()}
