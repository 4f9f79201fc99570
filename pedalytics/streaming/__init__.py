"""Incremental ingest of newly arrived source files with Structured Streaming.

The analysis itself is batch (monthly marts over whole tables); the only
continuously growing input is the drop of new monthly files.  That load
(files -> raw table, appended) runs here as a file stream with an
``availableNow`` trigger, so each run picks up exactly the files that
arrived since the previous one.
"""

from pedalytics.streaming.incremental import ingest_new_files  # noqa: F401
