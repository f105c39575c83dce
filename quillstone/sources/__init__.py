"""Readers and writers: records, lexicons, clouds, poses, judge files; tables in the shared folder."""
