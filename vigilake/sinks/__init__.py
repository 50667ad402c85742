"""Writers: receipts by day, node logs, trap events, SIEM exports."""
