"""Reports and stored scans."""
