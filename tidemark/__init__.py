"""Archive analytics as DataFrame functions: ledgers, histories, listings, plans and reports."""
