"""Readers and writers of beacons, calls, ledgers, raw rows, exports and status documents."""
