"""Streaming: intentionally empty.

The source application has no streams, watermarks, windows over time or
stateful operators (its only freshness idea is a result cache with a TTL),
so there is nothing to re-express with Structured Streaming. Every job in
this package is a batch DataFrame job; see README "Not built".
"""
