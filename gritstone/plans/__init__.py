"""Query texts and plans: dialect, clause reader, and access to Catalyst."""
