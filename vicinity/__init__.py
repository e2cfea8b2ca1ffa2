"""Vector-neighbourhood analytics and corpus preparation on Spark."""
